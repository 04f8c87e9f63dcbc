"""Gated recurrent networks in numpy, many lanes side by side.

Gates and candidates use the softsign x / (1 + |x|) in place of the logistic and tanh curves, at a third of the cost.
Inputs are ids: a table holds, for each id, what it adds to the two gates and the candidate.
"""

from __future__ import annotations

import numpy as np


def _soft(x: np.ndarray, spare: np.ndarray) -> None:
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def run_states(ids: np.ndarray, table: np.ndarray, inner: np.ndarray, pad: int, tape: list | None = None, state: np.ndarray | None = None) -> np.ndarray:
    """States (T, H, B) for ids (T, B), from ``state`` on or from zero; ``tape`` collects what the backward pass needs. The
    state is zero at pads."""
    steps, lanes = ids.shape
    size = inner.shape[1]
    out = np.empty((steps, size, lanes), np.float32)
    kept = steps if tape is not None else 1
    xs, us = (np.empty((kept, 3 * size, lanes), np.float32) for _ in range(2))
    spare = np.empty((3 * size, lanes), np.float32)
    first = np.zeros((size, lanes), np.float32) if state is None else state
    h, padded = first, (ids == pad).any(1)
    for t in range(steps):
        x, u = xs[t % kept], us[t % kept]
        np.take(table, ids[t], axis=1, out=x, mode="clip")
        np.matmul(inner, h, out=u)
        gates, new = x[: 2 * size], x[2 * size :]
        gates += u[: 2 * size]
        _soft(gates, spare[: 2 * size])
        gates *= 0.5
        gates += 0.5
        keep, reset = gates[:size], gates[size:]
        part = spare[:size]
        np.multiply(u[2 * size :], reset, out=part)
        new += part
        _soft(new, part)
        now = out[t]
        np.subtract(h, new, out=now)
        now *= keep
        now += new
        if padded[t]:
            now[:, ids[t] == pad] = 0
        h = now
    if tape is not None:
        tape.append((xs, us, out, first))
    return out


def run_back(ids: np.ndarray, inner: np.ndarray, pad: int, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (table, inner) from the gradient of all states: backpropagation through time. ``pad`` is the last id.

    The slopes of the softsign y are (1 - |y|) squared, so the tape needs no inputs of the curves.
    """
    steps, lanes = ids.shape
    size = inner.shape[1]
    ((xs, us, out, first),) = tape
    d_table, d_inner = np.zeros((3 * size, pad + 1), np.float32), np.zeros_like(inner)
    d_h, d_u, slope = np.zeros((size, lanes), np.float32), np.empty((3 * size, lanes), np.float32), np.empty((3 * size, lanes), np.float32)
    d_x, padded = np.empty((steps, 3 * size, lanes), np.float32), (ids == pad).any(1)
    for t in range(steps - 1, -1, -1):
        gates, new, lean = xs[t, : 2 * size], xs[t, 2 * size :], us[t, 2 * size :]
        keep, reset = gates[:size], gates[size:]
        before = out[t - 1] if t else first
        d_h += d_out[t]
        if padded[t]:
            d_h[:, ids[t] == pad] = 0
        d_keep, d_reset, d_new = d_x[t, :size], d_x[t, size : 2 * size], d_x[t, 2 * size :]
        of_gates, of_new = slope[: 2 * size], slope[2 * size :]
        np.abs(new, out=of_new)
        np.subtract(1, of_new, out=of_new)
        of_new *= of_new
        np.subtract(1, keep, out=d_new)
        d_new *= d_h
        d_new *= of_new
        np.subtract(before, new, out=d_keep)
        d_keep *= d_h
        np.multiply(d_new, lean, out=d_reset)
        np.subtract(1, gates, out=of_gates)
        np.minimum(of_gates, gates, out=of_gates)
        of_gates *= of_gates
        of_gates *= 2
        d_x[t, : 2 * size] *= of_gates
        d_u[: 2 * size] = d_x[t, : 2 * size]
        np.multiply(d_new, reset, out=d_u[2 * size :])
        d_inner += d_u @ before.T
        d_h *= keep
        d_h += inner.T @ d_u
    flat = ids.ravel()
    order = np.argsort(flat.astype(np.int16) if pad < 1 << 15 else flat, kind="stable")
    found, start = np.unique(flat[order], return_index=True)
    rows = d_x.transpose(0, 2, 1).reshape(-1, 3 * size)[order]
    d_table[:, found] = np.add.reduceat(rows, start, axis=0).T
    return d_table, d_inner

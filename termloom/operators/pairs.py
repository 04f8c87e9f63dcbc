"""Pairs of numbers in documents' arrays, counted in numpy within a task: a cell holds all pairs of two blocks of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

DOCS = 2048  # documents of a product of matrices; their counts are exact in single precision
CHUNK = 1 << 17  # pairs counted one by one at a time
DENSE = 700  # cells of a product that take the time of one such pair
ROWS = 1 << 20  # pairs given out at a time
CUT = 1000  # documents cut into blocks at a time
CELLS = "first long, i long, j long, part long, width long, left array<short>, right array<short>"
SCHEMA = "a long, b long, weight long"


def _lists(column: pa.ListArray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of some rows of a column of arrays."""
    offsets = column.offsets.to_numpy()[start : stop + 1]
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, i, j, part, width, left, right) of rows (first, width, part, ids): each document's distinct numbers, which begin at ``first``, in blocks
    of ``width``, and each two of its blocks i <= j with the numbers' places in them. Where i = j, right is null."""
    for batch in batches:
        for s in range(0, batch.num_rows, CUT):
            some = batch.slice(s, CUT)
            first, width, part = (some.column(k).to_numpy() for k in ("first", "width", "part"))
            values, sizes = _lists(some.column("ids"), 0, len(some))
            row = np.repeat(np.arange(len(sizes)), sizes)
            block, place = np.divmod(values - first[row], width[row])
            order = np.argsort(row * (block.max(initial=0) + 1) + block, kind="stable")
            row, block, place = row[order], block[order], place[order].astype(np.int16)
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))[: len(row)])
            row, block = row[starts], block[starts]  # of each document's blocks
            at = np.arange(len(starts))
            times = np.searchsorted(row, row, "right") - at  # this block and those after it
            left = np.repeat(at, times)
            right = left + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)), pa.int32()), pa.array(place))
            columns = [first[row[left]], block[left], block[right], part[row[left]], width[row[left]], lists.take(pa.array(left)), lists.take(pa.array(right, mask=left == right))]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["first", "i", "j", "part", "width", "left", "right"])


def _chosen(values: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values[np.repeat(some, sizes)], sizes[some]


def _product(total: np.ndarray, left: tuple, right: tuple | None) -> None:
    """Add the counts of some documents as the product of their matrices of zeros and ones."""

    def matrix(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sizes), len(total)), np.float32)
        m[np.repeat(np.arange(len(sizes)), sizes), values] = 1
        return m

    a = matrix(*left)
    b = a if right is None else matrix(*right)
    total += (a.T @ b).astype(total.dtype)


def _one_by_one(total: np.ndarray, left: tuple, right: tuple) -> None:
    """Add the counts of some documents pair by pair."""
    (x, m), (y, n) = left, right
    times = np.repeat(n, m)  # pairs of each number on the left
    shift = np.repeat(np.cumsum(n) - n, m) - (np.cumsum(times) - times)
    at = np.arange(times.sum()) + np.repeat(shift, times)
    np.add.at(total.reshape(-1), np.repeat(x.astype(np.int64) * len(total), times) + y[at], 1)


def _add(total: np.ndarray, left: tuple, right: tuple | None) -> None:
    """Add the counts of some documents, each in the way that takes less time. Without ``right`` both sides are the same."""
    other = left if right is None else right
    pairs = left[1].astype(np.int64) * other[1]
    many = pairs * DENSE >= total.size
    at = np.flatnonzero(many)
    for k in range(0, len(at), DOCS):
        some = np.zeros(len(many), bool)
        some[at[k : k + DOCS]] = True
        _product(total, _chosen(*left, some), None if right is None else _chosen(*right, some))
    few = _chosen(*left, ~many), _chosen(*other, ~many)
    ends = np.cumsum(pairs[~many])
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), len(ends)]) if len(ends) else []
    first = [np.concatenate(([0], np.cumsum(side[1]))) for side in few]
    for s, e in pairwise(cuts):
        _one_by_one(total, *((v[f[s] : f[e]], n[s:e]) for (v, n), f in zip(few, first, strict=True)))


def counts(batches: Iterator[pa.RecordBatch], least: int, diagonal: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, weight) with a <= b, or a < b without the ``diagonal``, in at least so many documents, of rows (first, i, j, width, left,
    right) sorted by (first, i, j): a document's numbers in blocks i and j of ``width`` numbers that begin at ``first``, as places in
    their block. Where i = j only ``left`` is read. No task holds more than one cell of counts."""
    cell, total = None, None

    def given() -> Iterator[pa.RecordBatch]:
        start, i, j, width = cell
        flat = np.flatnonzero((np.triu(total, 0 if diagonal else 1) if i == j else total).reshape(-1) >= least)
        for k in range(0, len(flat), ROWS):
            at = flat[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(start + i * width + at // width), pa.array(start + j * width + at % width), pa.array(total.reshape(-1)[at])], ["a", "b", "weight"])

    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in ("first", "i", "j", "width")], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for s, e in pairwise((0, *edges, len(keys))):
            if s == e:
                continue
            if cell != (now := tuple(map(int, keys[s]))):
                if cell:
                    yield from given()
                cell, total = now, np.zeros((now[3], now[3]), np.int64)
            _add(total, _lists(batch.column("left"), s, e), None if now[1] == now[2] else _lists(batch.column("right"), s, e))
    if cell:
        yield from given()

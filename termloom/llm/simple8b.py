"""Simple-8b word-aligned integer coding (Anh and Moffat, 2010), vectorised over blocks.

A 64-bit word holds a 4-bit selector on top and 60 bits of equal-width fields below, first value lowest. Values of
61 bits and more follow an escape word whose selector is 0 and which carries no value; they take the next word whole.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the coding: (values in a word, bits of each), by selector from 1 on. Selector 0 is the escape.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([0, *(n for n, _ in LAYOUTS)], np.int64)
ESCAPE_FROM = 1 << 60


def encode(values: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the coded words of all values, and where in them each block of ``block`` values starts."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.zeros(0, np.uint32)
    end = np.minimum(np.arange(0, n, block) + block, n)
    left = np.repeat(end, np.diff(np.append(np.arange(0, n, block), n))) - np.arange(n)
    choice = np.full(n, len(LAYOUTS), np.uint8)
    for selector in range(len(LAYOUTS) - 1, 0, -1):
        count, bits = LAYOUTS[selector - 1]
        small = np.flatnonzero(values < np.uint64(1 << bits))
        if len(small) >= count:  # heads of runs of count small values
            heads = small[: len(small) - count + 1][small[count - 1 :] - small[: len(small) - count + 1] == count - 1]
            choice[heads[left[heads] >= count]] = selector
    escaped = values >= np.uint64(ESCAPE_FROM)
    choice[escaped] = 0
    step = COUNTS[choice]
    step[escaped] = 1
    at, heads, lanes = np.arange(0, n, block), [], []
    lane = np.arange(len(at))
    while len(at):  # every block moves on by one word
        heads.append(at)
        lanes.append(lane)
        at = at + step[at]
        more = at < end[lane]
        at, lane = at[more], lane[more]
    heads, lanes = np.concatenate(heads), np.concatenate(lanes)
    order = np.argsort(heads)
    heads, lanes = heads[order], lanes[order]
    place = np.arange(len(heads)) + np.concatenate(([0], np.cumsum(escaped[heads])))[:-1]
    words = np.zeros(len(heads) + int(escaped[heads].sum()), np.uint64)
    picked = choice[heads]
    for selector, (count, bits) in enumerate(LAYOUTS, 1):
        mine = picked == selector
        if mine.any():
            first, word = heads[mine], np.full(np.count_nonzero(mine), selector << 60, np.uint64)
            for k in range(count):
                word |= values[first + k] << np.uint64(k * bits)
            words[place[mine]] = word
    raw = picked == 0
    words[place[raw] + 1] = values[heads[raw]]
    starts = np.searchsorted(lanes, np.arange(len(end)))
    return words, place[starts].astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of a run of whole blocks."""
    words = np.ascontiguousarray(words, np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[np.flatnonzero(selector == 0) + 1] = True  # a raw word's own top bits are never zero
    selector[raw] = 0
    count = np.where(raw, 1, COUNTS[selector])
    to = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(to[-1], np.uint64)
    for s, (n, bits) in enumerate(LAYOUTS, 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            word, first, mask = words[mine], to[mine], np.uint64((1 << bits) - 1)
            for k in range(n):
                out[first + k] = (word >> np.uint64(k * bits)) & mask
    out[to[:-1][raw]] = words[raw]
    return out


def decode_from(words: np.ndarray, offsets: np.ndarray, start: int, length: int, block: int = 512) -> np.ndarray:
    """Values start to start + length, from the blocks that hold them only."""
    if length <= 0:
        return np.empty(0, np.uint64)
    first, last = start // block, (start + length - 1) // block + 1
    stop = offsets[last] if last < len(offsets) else len(words)
    return decode(words[offsets[first] : stop])[start - first * block :][:length]


def runs(words: np.ndarray, offsets: np.ndarray, n: int, block: int = 512, blocks: int = 512):
    """Yield the ``n`` values in turn, ``blocks`` blocks at a time, each run found by its offset and decoded at once."""
    for start in range(0, n, block * blocks):
        yield decode_from(words, offsets, start, min(block * blocks, n - start), block)

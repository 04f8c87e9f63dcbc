"""SimHash near-duplicates over a Gray-order hierarchical index."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FANOUT = 16


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, repeats included; the whole sequence where it is shorter."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)


def fingerprint(text: str | None, width: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """64 majority bits, as a signed long; zero without words."""
    hashes = shingle_hashes(text or "", width, seed)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), chunk):
        part = np.ascontiguousarray(hashes[i : i + chunk])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    rank = codes.astype(np.uint64, copy=True)
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Nested groups of neighbours in Gray order.

    ``levels[0]`` holds the fingerprints; each level above holds, for every group of FANOUT entries, the bits that all
    of them share and their pattern. A node keeps only the shared bits its parent does not hold, so differences add up
    on the way down and a group is dropped as soon as the sum passes the limit.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        low = high = codes[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [(low, full)]
        while len(low) > 2 * FANOUT:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            self.levels.append((low, ~(low ^ high)))
        for i in range(len(self.levels) - 1):
            pattern, mask = self.levels[i]
            self.levels[i] = pattern, mask & ~np.repeat(self.levels[i + 1][1], FANOUT)[: len(mask)]

    def search(self, queries: np.ndarray, limit: int, batch: int = 1024):
        """Yield (query positions, code positions) of all pairs that differ in at most ``limit`` bits."""
        pattern, mask = self.levels[-1]
        for first in range(0, len(queries), batch):
            q = queries[first : first + batch]
            off = np.bitwise_count((q[:, None] ^ pattern) & mask)
            who, node = np.nonzero(off <= limit)
            off = off[who, node]
            for below, shared in self.levels[-2::-1]:
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                inside = child < len(below)
                child = np.where(inside, child, 0)
                sums = off[:, None] + np.bitwise_count((q[who][:, None] ^ below[child]) & shared[child])
                row, col = np.nonzero(inside & (sums <= limit))
                who, node, off = who[row], child[row, col], sums[row, col]
            yield who + first, self.order[node]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42, mark: Column | None = None) -> DataFrame:
    """(id, code, mark): the fingerprint of every whole text as a signed long, beside a string that goes with the row."""

    def read(batches):
        for batch in batches:
            codes = [fingerprint(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), batch.column(2)], names=["id", "code", "mark"])

    mark = (F.lit(None) if mark is None else mark).cast("string").alias("mark")
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), mark).mapInArrow(read, "id long, code long, mark string")


def links(classes: DataFrame, limit: int) -> DataFrame:
    """(a, b): representatives of any two classes whose codes differ in at most ``limit`` bits.

    ``classes`` has distinct (code, rep). Gray order is cut at quantiles into about a quarter of the square root of n
    leaves. The bits that all codes of a leaf share form the topmost index nodes, three numbers a leaf, which
    every task gets. Codes travel in packed rows, and only to leaves, at or after their own, that those nodes do not rule
    out; each leaf is searched through its own index.
    """
    n = classes.count()
    leaves = max(1, math.ceil(math.sqrt(n) / 4))

    def rank(batches):
        for batch in batches:
            order = gray_rank(batch.column(0).to_numpy().view(np.uint64)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order)], names=["code", "rep", "rank"])

    ranked = cut(classes.select("code", "rep").mapInArrow(rank, "code long, rep long, rank double"))
    cuts = ranked.approxQuantile("rank", [i / leaves for i in range(1, leaves)], 1 / (4 * leaves)) if leaves > 1 else []

    def place(batches):
        for batch in batches:
            leaf = np.searchsorted(np.sort(cuts), batch.column(2).to_numpy(), "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(leaf)], names=["code", "rep", "leaf"])

    placed = cut(ranked.mapInArrow(place, "code long, rep long, leaf long"))
    tops = placed.groupBy("leaf").agg(F.expr("bit_and(code)").alias("low"), F.expr("bit_or(code)").alias("high")).orderBy("leaf").collect()
    leaf = np.array([t["leaf"] for t in tops], np.int64)
    low, high = (np.array([t[c] for t in tops], np.int64).view(np.uint64) for c in ("low", "high"))
    shared = ~(low ^ high)

    def route(batches):
        for batch in batches:
            code, rep, own = (c.to_numpy() for c in batch.columns)
            near = np.zeros((len(code), len(leaf)), bool)
            for i in range(0, len(code), 4096):
                part = code[i : i + 4096].view(np.uint64)
                near[i : i + 4096] = np.bitwise_count((part[:, None] ^ low) & shared) <= limit
            near &= leaf >= own[:, None]
            to = np.flatnonzero(near.any(0))
            sent = [(code[near[:, k]].tobytes(), rep[near[:, k]].tobytes(), (own[near[:, k]] == leaf[k]).tobytes()) for k in to]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[to]), *(pa.array([s[c] for s in sent], pa.binary()) for c in range(3))], names=["leaf", "codes", "reps", "own"])

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held):
            index, reps = GrayIndex(held["code"].to_numpy().view(np.uint64)), held["rep"].to_numpy()
            for codes, mine, own in zip(asked["codes"], asked["reps"], asked["own"]):
                mine, own = np.frombuffer(mine, np.int64), np.frombuffer(own, bool)
                for who, where in index.search(np.frombuffer(codes, np.uint64), limit):
                    a, b = mine[who], reps[where]
                    new = (a != b) & (~own[who] | (a < b))
                    found.append(pd.DataFrame({"a": a[new], "b": b[new]}))
        return pd.concat(found) if found else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    routed = placed.mapInArrow(route, "leaf long, codes binary, reps binary, own binary")
    return placed.groupBy("leaf").cogroup(routed.groupBy("leaf")).applyInPandas(search, "a long, b long")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42, limit: int = 2, mark: Column | None = None) -> DataFrame:
    """(id, mark, code, component_id): one row per input row, as near_copies says."""
    coded = cut(fingerprints(docs, text, key, width, seed, mark))
    classes = coded.groupBy("code").agg(F.min("id").alias("rep"))
    known = cut(classes.where("rep is not null"))
    reached = components(links(known, limit), "a", "b")
    named = classes.join(reached, classes["rep"] == reached["id"], "left").select("code", F.coalesce("component", "rep").alias("component_id"))
    return coded.join(named, "code").select(coded["id"], "mark", "code", "component_id")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42, limit: int = 2) -> DataFrame:
    """(key, fingerprint, component_id): one row per input row.

    Texts are lower-cased in A-Z and cut at ASCII white space. Equal fingerprints form one class, so copies are never
    paired; classes whose fingerprints differ in at most ``limit`` bits are linked, and ``component_id`` is the
    smallest key reachable. Null, empty and blank texts have fingerprint zero and link like any other. A row with a null key
    follows its class and never names it; component_id is null where no row of the class has a key. Repeated rows
    give repeated results. An empty table gives an empty result. Other columns are not read.
    """
    found = groups(docs, text, key, width, seed, limit)
    return found.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, in their own columns: the smallest key of each component.

    Rows are judged by key and text: where several texts of the smallest key are in one component, the one with the smallest
    digest stays, and a key with texts in several components may stay for each. Rows with a null key are kept only where
    no row of their component has a key. Rows that repeat both key and text share one decision.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    found = cut(groups(docs, text, key, mark=digest, **options))
    first = found.where("id = component_id").groupBy("component_id").agg(F.min("mark").alias("first"))
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first"))
    gone = found.join(first, "component_id").where(~stays).select(F.col("id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["_gone"]) & (digest == gone["_mark"]), "left_anti")

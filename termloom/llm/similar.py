"""SimHash near copies at a given Jaccard similarity of word shingles.

A fingerprint radius that covers a similarity of 0.8 is about ten bits, at which a Gray-order index over a whole corpus rules
out almost nothing. So the corpus is first dealt into buckets by min-hashes of the shingles, texts of the wanted
similarity sharing a bucket with near certainty, and each bucket is searched through its own Gray-order index. What the
fingerprints link is then confirmed by the shingle sets themselves. Of pairs at 0.8 to 0.9 in random texts of 60, 120 and 400
words, ten bits hold all and eight buckets all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .components import components
from .simhash import LOWER, GrayIndex
from .store import cut, partitions

CELL = 2048  # members of a bucket that are compared with as many others in one task
FOLD = np.frombuffer(LOWER, np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(distinct word hashes, distinct shingle hashes) of each text, words lower-cased in A-Z; a text of fewer words than
    ``width`` has one shingle of them all, one without words has none."""
    data = FOLD[data]
    starts, ends, first = spans.words(data, offsets)
    hashes = spans.word_hashes(data, starts, ends)
    n = np.diff(first)
    at = np.arange(len(hashes))
    text = np.repeat(np.arange(len(n)), n)
    stop = np.minimum(at + width, first[1:][text])
    whole = (stop - at == width) | (at == first[:-1][text])
    runs, owner = spans.range_hashes(hashes, at[whole], stop[whole]), text[whole]
    edges = np.searchsorted(owner, np.arange(len(n) + 1))
    return [np.unique(hashes[a:b]) for a, b in pairwise(first)], [np.unique(runs[a:b]) for a, b in pairwise(edges)]


def majority(hashes: np.ndarray) -> int:
    """64 majority bits of a set of hashes, as a signed long."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bucket_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands): each key joins ``rows`` min-hashes of a non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for r in range(rows):
            seed = spans.mix(np.array([b * rows + r + 1], np.uint64) * spans.ODD)
            key = spans.mix(key * spans.ODD + np.minimum.reduceat(spans.mix(flat ^ seed), starts))
        keys[:, b] = key
    return keys.view(np.int64)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable | None = None) -> np.ndarray:
    """Roots of all members once the pairs (a, b) are united, those that ``linked`` confirms where it is given. A pair whose
    members already share a root needs no confirmation, so a dense group costs about one a member."""
    while True:
        todo = parent[a] != parent[b]
        a, b = a[todo], b[todo]
        if not len(a):
            return parent
        _, first = np.unique(a, return_index=True)
        x, y = a[first], b[first]
        good = np.ones(len(x), bool) if linked is None else linked(x, y)
        for p, q in zip(x[good].tolist(), y[good].tolist()):
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            parent[max(p, q)] = min(p, q)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        rest = np.ones(len(a), bool)
        rest[first] = False
        a, b = a[rest], b[rest]


def sorted_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in their first ``by`` columns, of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(by)], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in pairwise(edges):
            if a == b:
                continue
            if held and (a or (keys[a] != last).any()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def in_cells(members: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, i, j, *columns), sorted by the first three within partitions: members of a group of more than CELL meet in cells
    of two parts each, so that every pair of members shares a cell and no task holds more than two parts. Groups of one are left out."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / CELL).cast("int"))
    mine = members.join(sizes, group).withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select(group, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *columns)
    return cells.repartition(partitions(members.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _edges(nodes: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[root[moved]], pa.int64())], names=["u", "v"])


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, least: float = 0.8, limit: int = 10, bands: int = 8, rows: int = 2) -> DataFrame:
    """(id, mark, rep, stays): one row per row of ``docs`` with a key; mark is the SHA-256 of its text.

    Two texts are linked when they share a bucket, their fingerprints over distinct words differ in at most ``limit`` bits, and the
    Jaccard similarity of their sets of ``width``-word shingles is at least ``least``; groups are what links connect. Equal
    texts are one member, and ``rep`` is its smallest key. ``stays`` marks the smallest key of each group, and where several texts
    have it the one with the smallest mark. Words are lower-cased in A-Z. Texts without words, null ones too, link with nothing.
    Rows with a null key take no part. Repeated rows share one decision. Very long texts run whole. An empty table gives
    an empty result. Other columns are not read.
    """

    def describe(batches):
        for batch in batches:
            codes, keys = [], []
            for _, data, offsets in spans.chunks(batch.column(0)):
                words, sets = shingle_sets(data, offsets, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                found = iter(bucket_keys([sets[i] for i in full], bands, rows) if full else ())
                keys += [next(found) if len(s) else [] for s in sets]
                codes += [majority(w) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "mark", "code", "keys"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = docs.where(F.col(key).isNotNull()).select(body.alias("text"), F.col(key).cast("long").alias("id"), F.sha2(body, 256).alias("mark"))
    described = cut(marked.mapInArrow(describe, "id long, mark string, code long, keys array<long>"))
    classes = described.groupBy("mark").agg(F.min("id").alias("rep"), F.first("code").alias("code"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    def near(batches):
        for group in sorted_groups(batches, 3):
            nodes, codes = (group.column(c).to_numpy() for c in ("node", "code"))
            root = np.arange(len(nodes))
            for a, b in GrayIndex(codes.view(np.uint64)).search(codes.view(np.uint64), limit):
                root = unite(root, a, b)
            yield _edges(nodes, root)

    bucketed = in_cells(classes.select("node", "code", F.explode("keys").alias("bucket")), "bucket", "node", "code")
    near_groups = cut(components(bucketed.mapInArrow(near, "u long, v long"), "u", "v"))

    def sets_of(batches):
        for batch in batches:
            found = [s.tobytes() for _, data, offsets in spans.chunks(batch.column(0)) for s in shingle_sets(data, offsets, width)[1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=["node", "component", "code", "shingles"])

    def confirm(batches):
        for group in sorted_groups(batches, 3):
            nodes, codes = (group.column(c).to_numpy() for c in ("node", "code"))
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])

            def linked(x, y):
                good = np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y])
                for i in np.flatnonzero(good):
                    shared = len(np.intersect1d(sets[x[i]], sets[y[i]], assume_unique=True))
                    good[i] = shared >= least * (sizes[x[i]] + sizes[y[i]] - shared)
                return good

            root = np.arange(len(nodes))
            for a, b in GrayIndex(codes.view(np.uint64)).search(codes.view(np.uint64), limit):
                once = a < b
                root = unite(root, a[once], b[once], linked)
            yield _edges(nodes, root)

    wanted = classes.join(near_groups, classes["node"] == near_groups["id"]).select("node", "code", "component", "rep", F.col("mark").alias("mine"))
    texts = marked.join(wanted, (marked["id"] == wanted["rep"]) & (marked["mark"] == wanted["mine"])).dropDuplicates(["node"])
    sets = texts.select("text", "node", "component", "code").mapInArrow(sets_of, "node long, component long, code long, shingles binary")
    confirmed = components(in_cells(cut(sets), "component", "node", "code", "shingles").mapInArrow(confirm, "u long, v long"), "u", "v")
    named = classes.join(confirmed, classes["node"] == confirmed["id"], "left").select("mark", "rep", F.coalesce("component", "node").alias("group"))
    winners = named.groupBy("group").agg(F.min(F.struct("rep", "mark")).alias("winner"))
    decided = named.join(winners, "group").select("mark", "rep", (F.col("mark") == F.col("winner.mark")).alias("wins"))
    return described.select("id", "mark").join(decided, "mark").select("id", "mark", "rep", (F.col("wins") & (F.col("id") == F.col("rep"))).alias("stays"))


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay (similar_groups), in their own columns, and the rows without a key."""
    gone = similar_groups(docs, text, key, **options).where("NOT stays").select("id", "mark").distinct()
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    return docs.join(gone, (docs[key].cast("long") == gone["id"]) & (digest == gone["mark"]), "left_anti")

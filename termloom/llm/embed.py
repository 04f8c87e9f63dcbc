"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. All vectors are rotated to principal axes, which keeps distances, and
sorted by their grid cells of that width along the leading axes. The sequence is cut into blocks; two blocks are joined
only if their bounding boxes come within the width, and a join halves both intervals over and over, dropping pairs
of intervals whose boxes are provably too far apart, before it compares what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut, partitions

BOX = 16  # leading axes of the bounding boxes
VECTORS = "id long, label string, digest binary, dims int, body binary"


def _parse(batches):
    """Usable vectors only: body holds doubles, digest their identity."""
    for batch in batches:
        out = [[] for _ in range(5)]
        for k, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if k is None or label is None or not values.is_valid:
                continue
            if values.values.null_count:
                continue
            v = np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
            if len(v) and np.isfinite(v).all() and v.any():
                for column, x in zip(out, (k, label, hashlib.blake2b(v.tobytes(), digest_size=16).digest(), len(v), v.tobytes())):
                    column.append(x)
        types = pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "label", "digest", "dims", "body"])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest part to between a half and one, which is exact: squares neither
    overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(classes: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """For each vector length an orthogonal basis, leading axis first, from at most ``rows`` vectors in hash order. The basis decides only
    how much is skipped."""
    sample = classes.orderBy(F.xxhash64("rep"), "digest").limit(rows).select("dims", "body").collect()
    found: dict[int, list[np.ndarray]] = {}
    for r in sample:
        found.setdefault(r["dims"], []).append(np.frombuffer(r["body"], np.float64))
    return {d: np.linalg.eigh(np.cov(_unit(np.array(v)).T).reshape(d, d) if len(v) > 1 else np.eye(d))[1][:, ::-1] for d, v in found.items()}


def near_intervals(a: np.ndarray, b: np.ndarray, reach: float, leaf: int = 64):
    """Yield slices of the sequences a and b (leading coordinates) that may hold pairs within ``reach``."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        gap = np.maximum(0, np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)))
        if np.dot(gap, gap) > reach * reach:
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            yield slice(a0, a1), slice(b0, b1)
            continue
        am, bm = (a0 + a1) // 2 if a1 - a0 > leaf else a1, (b0 + b1) // 2 if b1 - b0 > leaf else b1
        todo += [(p, q, r, s) for p, q in ((a0, am), (am, a1)) if q > p for r, s in ((b0, bm), (bm, b1)) if s > r]


def join_blocks(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of the pairs with cosine >= least; y None joins x with itself, without the diagonal."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    other = x if y is None else y
    x, other = _scaled(x), _scaled(other)
    lead_x, lead_y = _unit(x) @ axes[:, :BOX], _unit(other) @ axes[:, :BOX]
    norm_x, norm_y = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, other))
    linked = np.zeros((len(x), len(other)), bool)
    for i, j in near_intervals(lead_x, lead_y, reach):
        linked[i, j] = x[i] @ other[j].T / (norm_x[i, None] * norm_y[None, j]) >= least
    if y is None:
        np.fill_diagonal(linked, False)
    return linked


def local_stars(linked: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, label of each column): equal labels where a chain of links leads; len(linked) for none.

    ``same``: row i and column i are one vector.
    """
    none = len(linked)
    rows = np.where(linked.any(1), np.arange(none), none)
    while True:
        columns = np.where(linked, rows[:, None], none).min(0)
        if same:
            columns = np.minimum(columns, rows)
        new = np.minimum(rows, np.where(linked, columns, none).min(1))
        new = np.where(new < none, np.append(new, none)[np.minimum(new, none)], none)
        if (new == rows).all():
            return rows, columns
        rows = new


def near_vectors(vectors: DataFrame, least: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", block_rows: int = 512, sample_rows: int = 4096) -> DataFrame:
    """(key, n_links, component_id, kept): one row per input row.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least ``least``.
    Identical vectors of a label are joined as one with its number of copies. ``n_links`` counts the other vectors a row
    links with, ``component_id`` is the smallest key reachable, ``kept`` marks it. A vector that is null, empty, zero or has null
    or non-finite parts, or has no key, links with nothing and is kept; vectors of different lengths never link. Rows
    that share a key are one node: each reports the links of all of them. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    parsed = cut(vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_parse, VECTORS))
    classes = cut(parsed.groupBy("label", "dims", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("body").alias("body")))
    axes = principal_axes(classes, sample_rows)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    basis = lambda d: axes.get(d, np.eye(d))

    def place(batches):
        for batch in batches:
            dims = batch.column(1).to_pylist()
            lead = [(_unit(np.frombuffer(b, np.float64)[None]) @ basis(d)[:, :3])[0] for d, b in zip(dims, batch.column(5).to_pylist())]
            cells = np.floor(np.array([np.pad(v, (0, 3 - len(v))) for v in lead]).reshape(-1, 3) / max(reach, 1e-6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(3))], names=[*batch.schema.names, "c1", "c2", "c3"])

    def block(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def row():
            nonlocal number
            number += 1
            dims = held[0][1]
            x = np.array([np.frombuffer(h[4], np.float64) for h in held])
            lead = (_unit(x) @ basis(dims))[:, :BOX]
            lo, hi = lead.min(0), lead.max(0)
            cells = sorted({(h[5], h[6]) for h in held})
            values = [held[0][0]], [dims], [number], [lo.tolist()], [hi.tolist()], [[{"c1": a, "c2": b} for a, b in cells]], [[h[2] for h in held]], [[h[3] for h in held]], [x.tobytes()]
            doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
            types = pa.string(), pa.int32(), pa.int64(), doubles, doubles, pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64())])), longs, longs, pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["label", "dims", "block", "lo", "hi", "cells", "reps", "copies", "body"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("label", "dims", "rep", "copies", "body", "c1", "c2")]
            for one in zip(*columns):
                if held and (len(held) == block_rows or held[0][:2] != one[:2]):
                    yield row()
                    held = []
                held.append(one)
        if held:
            yield row()

    order = ["label", "dims", "c1", "c2", "c3", "rep"]
    gridded = classes.select("label", "dims", "digest", "rep", "copies", "body").mapInArrow(place, "label string, dims int, digest binary, rep long, copies long, body binary, c1 long, c2 long, c3 long")
    n = max(1, partitions(spark))
    blocks = cut(gridded.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(block, "label string, dims int, block long, lo array<double>, hi array<double>, cells array<struct<c1: long, c2: long>>, reps array<long>, copies array<long>, body binary"))
    boxes = blocks.select("label", "dims", "block", "lo", "hi", F.explode("cells").alias("cell"))
    left = boxes.select("label", "dims", F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("cell.c1").alias("c1"), F.col("cell.c2").alias("c2"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = boxes.select("label", "dims", "block", "lo", "hi", "cell", F.explode(steps).alias("s")).select("label", "dims", F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), (F.col("cell.c1") + F.col("s.i")).alias("c1"), (F.col("cell.c2") + F.col("s.j")).alias("c2"))
    gaps = "aggregate(zip_with(arrays_zip(lo_a, hi_a), arrays_zip(lo_b, hi_b), (x, y) -> greatest(0d, y.lo_b - x.hi_a, x.lo_a - y.hi_b)), 0d, (s, g) -> s + g * g)"
    pairs = left.join(around, ["label", "dims", "c1", "c2"]).where("a <= b").where(F.expr(gaps) <= reach * reach).select("a", "b").distinct()
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("dims").alias(f"dims_{s}"), F.col("reps").alias(f"reps_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("body").alias(f"body_{s}"))
    work = pairs.join(side("a"), "a").join(side("b").drop("dims_b"), "b")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same, d = r["a"] == r["b"], r["dims_a"]
                x, y = (np.frombuffer(r[f"body_{s}"], np.float64).reshape(-1, d) for s in "ab")
                linked = join_blocks(x, None if same else y, basis(d), least)
                if not linked.any():
                    continue
                reps_a, reps_b, copies_a, copies_b = (np.array(r[f"{c}_{s}"], np.int64) for c in ("reps", "copies") for s in "ab")
                rows, columns = local_stars(linked, same)
                counts = [(reps_a, linked @ copies_b)] + ([] if same else [(reps_b, copies_a @ linked)])
                stars = [(reps_a, rows)] + ([] if same else [(reps_b, columns)])
                for reps, c in counts:
                    yield _rows(reps[c > 0], None, c[c > 0])
                for reps, s in stars:
                    inside = s < len(reps_a)
                    yield _rows(reps[inside], reps_a[s[inside]], None)

    found = cut(work.mapInArrow(compare, "u long, v long, n long"))
    counted = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("links"))
    reached = components(found.where("n is null"), "u", "v")
    own = classes.select("label", "dims", "digest", "rep", "copies")
    named = own.join(counted, own["rep"] == counted["u"], "left").join(reached, own["rep"] == reached["id"], "left")
    named = named.select("label", "dims", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = parsed.select("id", "label", "dims", "digest").join(named, ["label", "dims", "digest"]).groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    every = vectors.select(F.col(key).cast("long").alias("id"))
    out = every.join(member, "id", "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _rows(u, v, n) -> pa.RecordBatch:
    blank = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), blank if v is None else pa.array(v, pa.int64()), blank if n is None else pa.array(n, pa.int64())], names=["u", "v", "n"])

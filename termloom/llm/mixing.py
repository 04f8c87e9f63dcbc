"""Mixing sources to target weights with a Pfair schedule of blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import column, cut, partitions, staged


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly their proportions."""
    if weights and not (min(weights.values()) > 0 and all(map(math.isfinite, weights.values()))):
        raise ValueError("every source needs a positive, finite weight")
    exact = {n: Fraction(w) for n, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in exact.values()))
    whole = {n: int(f * unit) for n, f in exact.items()}
    common = math.gcd(*whole.values())
    return {n: a // common for n, a in whole.items()}


def quotas(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Slots of each source in the first ``frame`` slots: largest remainders, ties by name."""
    whole = shares(weights)
    total = sum(whole.values())
    slots = {n: a * frame // total for n, a in whole.items()}
    for n in sorted(whole, key=lambda n: (-(whole[n] * frame % total), n))[: frame - sum(slots.values())]:
        slots[n] += 1
    return slots


def schedule(whole: dict[str, int]) -> Iterator[tuple[int, str, int, int, int]]:
    """(slot, source, block, release, deadline) of each slot, without end, for weights in whole numbers.

    Block j of a source with a of A parts may start at slot floor(j A / a) and must be done by ceil((j + 1) A / a); at each
    slot the released block with the earliest deadline runs, ties by name. The weights fill every slot, so on one
    resource earliest deadline first meets every deadline, which keeps each source within one block of its share.
    """
    total = sum(whole.values())
    waiting = [(0, n, 0) for n, a in whole.items() if a]
    ready: list[tuple[int, str, int, int]] = []
    heapq.heapify(waiting)
    t = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            release, n, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[n]), n, j, release))
        deadline, n, j, release = heapq.heappop(ready)
        yield t, n, j, release, deadline
        heapq.heappush(waiting, ((j + 1) * total // whole[n], n, j + 1))
        t += 1


def filled(whole: dict[str, int], blocks: dict[str, int], frame: int) -> Iterator[tuple[int, str, int, int, int]]:
    """The rows of the schedule for as many ``blocks`` as each source has.

    While at least a quarter of the slots hold blocks, ``frame`` slots aside, slots of sources that have run out stay empty as in the
    schedule. Then these sources leave it, and the clock moves to the next release, so that the work grows with the blocks and not with
    the slots: blocks still start at their release or later and meet their deadlines, as fewer compete.
    """
    total, todo, placed, t = sum(whole.values()), sum(blocks.values()), 0, 0
    done = dict.fromkeys(blocks, 0)
    for row in schedule(whole):
        t, n, j = row[:3]
        if placed == todo or t >= frame + 4 * placed:
            break
        if j < blocks.get(n, 0):
            done[n], placed = j + 1, placed + 1
            yield row
    waiting = [(done[n] * total // whole[n], n, done[n]) for n in blocks if done[n] < blocks[n]]
    ready: list[tuple[int, str, int, int]] = []
    heapq.heapify(waiting)
    while waiting or ready:
        t = t if ready else max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, n, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[n]), n, j, release))
        deadline, n, j, release = heapq.heappop(ready)
        yield t, n, j, release, deadline
        t += 1
        if j + 1 < blocks[n]:
            heapq.heappush(waiting, ((j + 1) * total // whole[n], n, j + 1))


def pfair_frame(slots: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of each slot of one frame, after which the schedule of ``slots`` repeats."""
    return [row[1:] for row in islice(schedule(slots), sum(slots.values()))]


def size_weights(docs: DataFrame, power: float, source: str = "source", most: int = 10_000) -> dict[str, float]:
    """Target weights in proportion to each source's row count to the ``power``: below 1 small sources gain. One number a
    source reaches the driver; more than ``most`` sources are an error."""
    rows = docs.groupBy(F.coalesce(column(source).cast("string"), F.lit("")).alias("s")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r["s"]: float(r["count"]) ** power for r in rows}


def mix(docs: DataFrame, weights: dict[str, float], block_rows: int = 32, frame: int = 1000, source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """(key, source, block, place, slot, release, deadline): one row per input row, with its place in the mixture.

    The rows of a source, in hash order of the key, form blocks of ``block_rows``; ``place`` is a row's place in its block, the
    last block of a source may be short. The whole run is scheduled from the exact weights (schedule, filled), up to the last
    block of every source; one task streams its blocks, ``frame`` of them at a time, and holds one block a source. Sorting by (slot,
    place) gives the mixture: up to the end of the first source to run out, every prefix of slots holds each source's target
    share to within less than one block; from there on the other sources keep their proportions to each other. All
    rows are placed.

    A null source is the source ''. A source without a target weight is an error, and so is a weight that is not
    positive; weights of absent sources leave their slots empty. Rows with a null key come first in
    their source; repeated rows are placed each, ties in any order. An empty table gives an empty result. Other columns are not read.

    Ranks within a source come from one range partitioning by (source, hash, key) and the row counts of its parts, so
    a source that holds a large share of the rows is spread over many tasks.
    """
    spark = docs.sparkSession
    whole = shares(weights)
    table = spark.createDataFrame([(n,) for n in whole], "s string")
    rows = docs.select(column(key).alias("id"), F.coalesce(column(source).cast("string"), F.lit("")).alias("s"))
    rows = rows.withColumn("h", F.xxhash64("id", F.lit(seed)))
    lost = rows.select("s").distinct().join(table, "s", "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"no target weight for {[r['s'] for r in lost]}")
    order = ["s", "h", "id"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("id", "s", F.monotonically_increasing_id().alias("n"), F.spark_partition_id().alias("part")))
    parts = dealt.groupBy("s", "part").agg(F.min("n").alias("first_n"), F.count("*").alias("rows"))
    left = {r["s"]: -(-r["n"] // block_rows) for r in parts.groupBy("s").agg(F.sum("rows").alias("n")).collect()}
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("s", "part", (before - F.col("first_n")).alias("shift"))
    rank = dealt.join(F.broadcast(parts), ["s", "part"]).select("id", "s", (F.col("n") + F.col("shift")).alias("rank"))

    def run(_):
        slots = filled(whole, left, frame)
        while found := list(islice(slots, frame)):
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, row)) for row in found], schema=kind)

    kind = pa.schema([("slot", pa.int64()), ("s", pa.string()), ("block", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])
    slots = staged(spark.range(1).repartition(1).mapInArrow(run, "slot long, s string, block long, release long, deadline long"), "slots")
    blocks = rank.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    return blocks.join(slots, ["s", "block"]).select(F.col("id").alias(key), F.col("s").alias(source), "block", (F.col("rank") % block_rows).alias("place"), "slot", "release", "deadline")


def in_mixed_order(docs: DataFrame, placed: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` in their own columns, whatever their names, sorted by their place in the mixture; all rows of one key, null
    ones too, go to its first place. An empty table gives an empty result."""
    order = placed.groupBy(column(key).alias("key")).agg(F.min(F.struct("slot", "place")).alias("at"))
    rows = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), column(key).alias("mine"))
    joined = rows.join(order, F.col("mine").eqNullSafe(F.col("key"))).select("row", "at.slot", "at.place")
    n = partitions(docs.sparkSession)
    mixed = joined.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place")
    return mixed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])

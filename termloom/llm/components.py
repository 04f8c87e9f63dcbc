"""Connected components of an edge table by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two keyed aggregations and
joins; no vertex list reaches the driver, and a hub's neighbours sit on the splittable side of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _smallest(down)
    moved = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): every vertex that has an edge, with the smallest vertex of its component.

    ``edges`` holds integer pairs in any direction; loops, repeated pairs and nulls are ignored. An empty table gives
    an empty result. Raises RuntimeError if the stars have not settled after ``max_rounds`` rounds.
    """
    links = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        mark = now
    raise RuntimeError("components did not settle")

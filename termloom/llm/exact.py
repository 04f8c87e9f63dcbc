"""Exact duplicates by a distributed content sort, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import column, cut, partitions


def _runs(docs: DataFrame, text: str, key: str, normalise=None, lead: int = 16, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with their runs, and the texts that are frequent.

    The rows (id, body[, row], digest, top, members, place, salted): the text, its run's largest key and number of rows, and
    the row's place in the run by falling key. ``carry`` keeps the other columns of ``docs``, and whether the text was null,
    in ``row``.
    """
    n = max(2, partitions(docs.sparkSession))
    body = F.coalesce(column(text), F.lit(""))
    body = normalise(body) if normalise else body
    rest = [F.struct(column(text).isNull().alias("null"), F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]).alias("rest")).alias("row")] if carry else []
    rows = docs.select(column(key).alias("id"), body.alias("body"), *rest).withColumn("mark", F.xxhash64("body"))
    # One short row a text. Frequent are the texts that hold a quarter of a task's fair part of all rows or bytes: at most 8 n of them.
    texts = cut(rows.groupBy("mark").agg(F.count("*").alias("rows"), F.sum(F.octet_length("body")).alias("bytes")))
    total = texts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    parts = F.ceil(4 * n * F.greatest(F.col("rows") / max(1, total["rows"]), F.col("bytes") / max(1, total["bytes"]))).cast("int")
    frequent = texts.where("rows > 1").select("mark", parts.alias("parts")).where("parts > 1")
    salted = rows.join(F.broadcast(frequent), "mark", "left").withColumn("salted", F.col("parts").isNotNull())
    place = {"lead": F.substring("body", 1, lead), "salt": F.when(F.col("salted"), F.pmod(F.xxhash64("id"), "parts")).otherwise(0)}
    order = ["lead", "mark", "salt"]
    placed = salted.withColumns(place).repartitionByRange(n, *order).sortWithinPartitions(*order, "body")
    run = Window.partitionBy(*order, "body")
    columns = {
        "digest": F.sha2("body", 256),
        "top": F.max("id").over(run),
        "members": F.count("*").over(run),
        "place": F.row_number().over(run.orderBy(F.col("id").desc_nulls_last())),
    }
    return placed.withColumns(columns).drop(*order, "parts"), frequent


def sorted_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise=None, lead: int = 16) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): one row per input row, dropped rows included.

    Sampled splitters range-partition the normalised text by its first ``lead`` characters, then a hash of the whole, so
    that the sample stays small however long the texts are. An external sort puts equal texts side by side, and neighbours are
    compared in full, which gives each run of equals its size and its largest key; equal texts form one run. Only a text that
    holds so many of all rows or bytes that it would fill a task, which a count by hash shows beforehand, is dealt over
    several tasks by a salt; its few runs then meet by digest.

    ``normalise``: Column -> Column applied to the text (default: no change). The largest key of equal texts stays.
    Null texts count as empty and so equal each other and ''. Rows with a null key take part in the group size; they
    stay only where every key of their group is null, and then all of them are kept with a null keep_id. Repeated rows
    (same key and text) each count and share one decision. An empty table gives an empty result. Other columns of
    ``docs`` are not read, so clashing names do no harm.
    """
    runs, _ = _runs(docs, text, key, normalise, lead)
    runs = cut(runs.select("id", "digest", "top", "members", "salted", (F.col("place") == 1).alias("first")))
    merged = runs.where("salted AND first").groupBy("digest").agg(F.max("top").alias("all_top"), F.sum("members").alias("all_members"), F.lit(True).alias("salted"))
    # One row for each frequent text: a bounded number.
    met = runs.join(F.broadcast(merged), ["digest", "salted"], "left")
    merged_too = F.col("all_members").isNotNull()
    keep = F.when(merged_too, F.col("all_top")).otherwise(F.col("top"))
    size = F.coalesce("all_members", "members")
    return met.select(F.col("id").alias(key), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each text, in the columns of ``docs``: that of the largest key.

    Null and empty texts are one text. Of rows that repeat both key and text any one stays, and so does any one where no row of the
    text has a key. An empty table gives an empty result. Columns of any name pass unchanged. The rows travel once, in the content
    sort; what the tasks of a frequent text find is settled in a second look at the winners of these texts, one a task.
    """
    runs, frequent = _runs(docs, text, key, carry=True)
    won = runs.where("place = 1")
    whole = [F.when(~F.col("row.null"), F.col("body")).alias(c) if c == text else F.col("row.rest").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if frequent.isEmpty():
        return won.select(*whole)
    hot = docs.join(F.broadcast(frequent), F.xxhash64(F.coalesce(column(text), F.lit(""))) == frequent["mark"], "left_semi")
    tops = _runs(hot, text, key)[0].where("place = 1").groupBy("digest").agg(F.max("id").alias("all_top"))
    met = won.join(F.broadcast(tops), "digest", "left")
    return met.where(~F.col("salted") | F.col("all_top").isNull() | F.col("id").eqNullSafe(F.col("all_top"))).select(*whole)

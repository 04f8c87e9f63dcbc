"""Queries that drain a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.storage import scratch
from termloom.streaming import incremental as S

from .base import query
from .corpora import TEXT_SQL


@query("l1_incremental_index", "SELECT doc_id, term, weight FROM doc_terms", TEXT_SQL)
def l1(spark, sf_dir):
    def extract(batch):
        counts = batch.select("doc_id", F.explode(T.counted(T.tokens(F.lower("text")))).alias("t"))
        return counts.select("doc_id", "t.term", "t.weight").where(F.length("term") > 1)

    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/documents.parque[t]")
    out = scratch(spark, "index")
    S.index_stream(docs, extract, out, scratch(spark, "index-log")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "term", "weight")


@query("l2_stream_history", "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY 1")
def l2(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    events = spark.readStream.schema(batch.schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parque[t]")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "history")
    counts = S.history_stream(events).withColumn("value", F.round("value", 4))
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "history-log")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _is_folder(spark, path: str) -> bool:
    """Streams read folders or patterns; a table may be one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()

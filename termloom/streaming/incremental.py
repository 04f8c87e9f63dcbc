"""Continuous counterparts: indexing new documents as they arrive, and histories on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def index_stream(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write the (doc_id, term, weight) rows of documents that have not been indexed before to the table at ``path`` (L1).

    The stream's state holds the ids of all documents seen, in the checkpoint: a document that comes back, in the same batch or after
    a restart, with its old text or another, adds nothing. A batch is read and written once, without a look at the index; one that is run
    again replaces its own files, which carry its number. For many documents give the session RocksDB as its state store.
    """

    def add(batch: DataFrame, number: int) -> None:
        made, name = f"{path}/_batches/{number}", f"{path}/batch-{number:010}"  # readers pass over names that begin with _
        extract(batch).write.mode("overwrite").parquet(made)
        context = batch.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path
        files = at(path).getFileSystem(context._jsc.hadoopConfiguration())
        for old in files.globStatus(at(f"{name}-*")):
            files.delete(old.getPath(), False)
        for i, new in enumerate(files.globStatus(at(f"{made}/part-*"))):
            files.rename(new.getPath(), at(f"{name}-{i:05}.parquet"))
        files.delete(at(made), True)

    return docs.dropDuplicates(["doc_id"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_stream(events: DataFrame, time: str = "ts", value: str = "value", size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(bucket, n, value) of tumbling windows on an event-time stream; rows later than ``delay`` are dropped (L2)."""
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, delay)
    counts = timed.groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    return counts.select(F.col("w.start").alias("bucket"), "n", "value")

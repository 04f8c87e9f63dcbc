"""Reliable checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if Spark is local, as in tests, and else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="termloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back. For loops: what the optimizer infers of a plan, and a checkpoint
    hands on, starts anew here, where it would double in every round."""
    return staged_at(df)[0]


def staged_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``staged``, and the path of the table."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/termloom-{uuid.uuid4().hex}/{name}"


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A column with each row's place, from 0, in the whole order: one range partitioning and the row counts of its parts, so that no
    task holds more than a part. ``order`` should decide every tie."""
    number, part = (f"{p}_{uuid.uuid4().hex}" for p in ("n", "part"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({number: F.monotonically_increasing_id(), part: F.spark_partition_id()})
    dealt = checkpointed(dealt)
    parts = dealt.groupBy(part).agg(F.min(number).alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    shift = parts.select(part, (F.coalesce(before, F.lit(0)) - F.col("first")).alias(name))
    return dealt.join(F.broadcast(shift), part).withColumn(name, F.col(name) + F.col(number)).drop(number, part)


def replace_partitions(df: DataFrame, path: str, by: str = "corpus_id") -> None:
    """Write a result so that the partitions it holds replace those of the same value, and no others."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)

"""Token-id files: whole texts as ids in Simple-8b words, in key order.

A token folder is a Parquet table with one row per group of neighbouring documents:

    part int, chunk int      place in key order
    keys array<long>         the documents' keys, in order
    lengths array<long>      ids of each document, the end id included
    words binary             Simple-8b words of all ids, little-endian
    offsets binary           little-endian unsigned 32-bit: word at which each block of ``BLOCK`` ids starts
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b, subwords
from .store import partitions

BLOCK = 512
BROADCAST_CHUNKS = 500_000  # chunks whose starts are sent to every task, about 24 bytes each
SCHEMA = "part int, chunk int, keys array<long>, lengths array<long>, words binary, offsets binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id", chunk_ids: int = 1 << 18) -> None:
    """Write the ids of every whole text to the token folder ``path``, in ascending order of the key, then of the
    text's hash.

    Null and empty texts have the end id only; null keys come first; rows that repeat a key are all written. A long
    text makes one chunk of its own. An empty table gives a folder without rows. Other columns are not read.
    """
    spark = docs.sparkSession

    def pack(batches):
        part, chunk, coder = TaskContext.get().partitionId(), 0, subwords.encoder(vocabulary)
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        keys, ids, size = [], [], 0

        def row():
            words, offsets = simple8b.encode(np.frombuffer(b"".join(ids), "<u4"), BLOCK)
            values = [part], [chunk], [keys], [[len(x) // 4 for x in ids]], [words.astype("<u8").tobytes()], [offsets.astype("<u4").tobytes()]
            types = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["part", "chunk", "keys", "lengths", "words", "offsets"])

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                ids.append(coder.encode(body.as_py()) + tail)
                size += len(ids[-1]) // 4
                if size >= chunk_ids:
                    yield row()
                    keys, ids, size, chunk = [], [], 0, chunk + 1
        if keys:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    first = F.col("id").asc_nulls_first()
    dealt = rows.repartitionByRange(2 * partitions(spark), first, F.xxhash64("text"))
    dealt.sortWithinPartitions(first, F.xxhash64("text"), "text").mapInArrow(pack, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document in a token folder.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over little-endian unsigned 32-bit ids. Chunks
    are decoded a bounded number of blocks at a time, found by their offsets, so that without ``ids`` a very long document is never
    whole in memory. Starts are sums over two windows, over the chunks of a part and over the parts, one row each; they are
    broadcast up to BROADCAST_CHUNKS, counted first, and met in a join of both sides beyond. Null and
    repeated keys are read as written, a document without ids has length zero, and a folder without rows gives none.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sized = files.select("part", "chunk", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("base"))
    inside = sized.select("part", "chunk", earlier(Window.partitionBy("part").orderBy("chunk")).alias("inside"))
    starts = inside.join(parts, "part").select("part", "chunk", (F.col("base") + F.col("inside")).alias("start"))
    if files.count() <= BROADCAST_CHUNKS:
        starts = F.broadcast(starts)

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words, offsets = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4")
                lengths = r["lengths"]
                ends, sums, held = np.cumsum(lengths), [0] * len(lengths), [[] for _ in lengths]
                at = i = 0
                for values in simple8b.runs(words, offsets, int(ends[-1]), BLOCK):
                    values, done = values.astype("<u4"), 0
                    while done < len(values):
                        while ends[i] == at:  # documents without ids
                            i += 1
                        piece = values[done : done + int(ends[i]) - at]
                        sums[i] = zlib.crc32(piece, sums[i])
                        if ids:
                            held[i].append(piece.astype(np.int64))
                        done += len(piece)
                        at += len(piece)
                out = [pa.array(r["keys"], pa.int64()), pa.array(ends - lengths + r["start"]), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([np.concatenate(h) if h else [] for h in held], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return files.join(starts, ["part", "chunk"]).select("keys", "lengths", "words", "offsets", "start").mapInArrow(unpack, schema)

"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords


def pieces(n: int, longest: int) -> list[int]:
    """Lengths that sum to n: full pieces first, then the binary digits of the rest, descending."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, longest: int = 1024, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]): one row per piece.

    A document's ids, the end id last, are cut into pieces of power-of-two lengths up to ``longest``, itself a power
    of two. Each piece is a whole sequence in the bucket of its length, so a batch drawn from one bucket needs no padding
    and no attention across documents; ``bucket`` is the length's exponent. ``sequence_id`` holds the task in its upper
    bits and counts pieces below, as the input's partitions deal them. The work is one pass over the rows without
    a shuffle, and pieces leave as they are made.

    Null and empty texts have the end id only. Rows that repeat a key are packed each. A null key stays null. An empty
    table gives no pieces. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        coder, tail = subwords.encoder(vocabulary), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = [[] for _ in range(9)]
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(coder.encode(body.as_py()) + tail)
                start = 0
                for length in pieces(len(raw) // 4, longest):
                    piece = raw[4 * start : 4 * (start + length)]
                    row = k, start, length, zlib.crc32(piece), len(raw) // 4, sequence, 0, length.bit_length() - 1
                    for column, value in zip(out, row):
                        column.append(value)
                    if ids:
                        out[8].append(np.frombuffer(piece, "<u4").astype(np.int64))
                    start += length
                    sequence += 1
            types = [pa.int64()] * 7 + [pa.int32()] + [pa.list_(pa.int64())] * ids
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names[: len(types)])

    schema = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<long>" * ids
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)

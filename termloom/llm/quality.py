"""Quality scores from supervised subword embeddings.

Words, word pairs and character n-grams (bytes) are hashed to rows of one table of learned vectors; a document is their
mean, and a softmax layer over it gives the probability of label 1. For scoring, the layer is multiplied into the
table beforehand, which leaves one number a row and the same result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

BUCKETS = 1 << 16
#: All pairs of a word with itself share one hash: a stuttering text is one whatever word it repeats.
REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of the table, first of each text and the total) for words, word pairs, and 3 and 4 bytes in a row."""
    starts, ends, first = spans.words(data, offsets)
    hashes = spans.word_hashes(data, starts, ends)
    out = [((hashes >> np.uint64(48)).astype(np.int32), first)]
    if len(hashes) > 1:
        pair = np.where(hashes[:-1] == hashes[1:], REPEAT, spans.mix(hashes[:-1] * spans.ODD + hashes[1:]))
        inside = np.ones(len(pair), bool)
        inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hashes))] - 1] = False
        kept = np.concatenate(([0], np.cumsum(inside)))
        out.append(((pair[inside] >> np.uint64(48)).astype(np.int32), kept[np.minimum(first, len(pair))]))
    codes = data.astype(np.uint32)
    for width, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        n = len(codes) - width + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint32)
        for k in range(width):
            h *= np.uint32(257)
            h += codes[k : k + n]
        h *= np.uint32(salt)
        rows = (h >> np.uint32(16)).astype(np.int32)
        inside = np.ones(n, bool)
        for back in range(1, width):
            cut = offsets[1:-1] - back
            inside[cut[(cut >= 0) & (cut < n)]] = False
        kept = np.concatenate(([0], np.cumsum(inside)))
        out.append((rows[inside], kept[np.minimum(offsets, n)]))
    return out


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def sgd(bags: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, dim: int = 10, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> tuple[np.ndarray, float]:
    """(a number for each row of the table, offset): the folded model.

    One step per document: its mean vector, the softmax error, and updates of the layer and of the document's rows by
    their shares, of a length that moves the mean equally far for short and long documents.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    total, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, share = bags[i]
            mean = share @ table[rows]
            scores = layer @ mean + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[truth[i]] -= 1
            now = 1 - done / total
            back = p @ layer
            layer -= 0.5 * now * np.outer(p, mean)
            bias -= 0.05 * now * p
            table[rows] -= (rate * now / np.dot(share, share)) * share[:, None] * back
            done += 1
    return (table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", text: str = "text", key: str = "doc_id", sample_rows: int = 4000) -> tuple[np.ndarray, float]:
    """The folded model of a bounded sample: at most ``sample_rows`` labelled rows for which ``learn`` (a condition on the
    key) holds, in hash order of the key. A key labelled twice counts once, with its larger label; null labels and texts are left
    out. Without labelled rows every score is one half; with one label only, all scores lie on its side.
    """
    picked = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("pick")).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("pick"), "pick").limit(sample_rows)
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col("id") == F.col("pick"))

    def fit(batches):
        bags = []
        for batch in batches:
            for k, y, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data, offsets = spans.flat(pa.array([body.as_py()]))
                rows, n = np.unique(np.concatenate([r for r, _ in features(data, offsets)]), return_counts=True)
                bags.append((str(k), y, rows.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        bags.sort(key=lambda b: b[:2])
        weights, bias = sgd([b[2:] for b in bags], np.array([int(b[1] > 0) for b in bags], int)) if bags else (np.zeros(BUCKETS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights, bias))])], names=["model"])

    row = chosen.select("id", "y", "text").repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(row["model"]) if row else (np.zeros(BUCKETS, np.float32), 0.0)


def score_texts(model: tuple[np.ndarray, float], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    weights, bias = model
    sums, counts = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for rows, first in features(data, offsets):
        sums += segment_sums(weights[rows], first)
        counts += np.diff(first)
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + bias, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted): the probability of label 1 of every whole text, and whether it reaches ``threshold``.

    Null and empty texts have no features and get the model's prior. Repeated rows give repeated results; an empty table
    none. Columns other than the key and the text are not read.
    """

    def read(batches):
        for batch in batches:
            scores = [score_texts(model, data, offsets) for _, data, offsets in spans.chunks(batch.column(1))]
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", key)

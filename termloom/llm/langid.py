"""Language identification with a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled from the states of a forward and a backward network at that byte; the label
probabilities of all bytes are averaged. Both networks start anew at windows of a fixed number of bytes, so that a text of any
length is many short lanes that run side by side.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gru import run_back, run_states

PAD = 256


class Network:
    """Both directions, the label layer and the names of the labels."""

    def __init__(self, labels: list[str], size: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.size = labels, size
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.weights = {f"{k}{d}": v for d in "fb" for k, v in (("table", draw(3 * size, PAD + 1, by=0.5)), ("inner", draw(3 * size, size, by=size**-0.5)), ("out", draw(len(labels), size, by=size**-0.5)))}
        self.weights["bias"] = np.zeros((len(labels), 1), np.float32)

    def position_probabilities(self, ids: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        """(T, labels, B) for byte ids (T, B)."""
        w = self.weights
        self.ahead = run_states(ids, w["tablef"], w["innerf"], PAD, tapes["f"] if tapes else None)
        self.behind = run_states(ids[::-1], w["tableb"], w["innerb"], PAD, tapes["b"] if tapes else None)[::-1]
        scores = np.matmul(w["outf"], self.ahead)
        scores += np.matmul(w["outb"], self.behind)
        scores += w["bias"]
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def gradients(self, ids: np.ndarray, truth: np.ndarray, share: np.ndarray | float = 1.0) -> tuple[float, dict]:
        """Mean loss over the real positions, by the share of each lane, and the gradient of every weight."""
        w, tapes = self.weights, {"f": [], "b": []}
        p = self.position_probabilities(ids, tapes)
        real = (ids != PAD) * np.asarray(share, np.float32)
        real /= max(1e-30, real.sum())
        lanes = np.arange(ids.shape[1])
        loss = -float((np.log(np.maximum(p[:, truth, lanes], 1e-30)) * real).sum())
        p[:, truth, lanes] -= 1
        p *= real[:, None, :]
        g = {"bias": p.sum((0, 2))[:, None], "outf": np.einsum("tlb,thb->lh", p, self.ahead, optimize=True), "outb": np.einsum("tlb,thb->lh", p, self.behind, optimize=True)}
        g["tablef"], g["innerf"] = run_back(ids, w["innerf"], PAD, tapes["f"], np.matmul(w["outf"].T, p))
        g["tableb"], g["innerb"] = run_back(ids[::-1], w["innerb"], PAD, tapes["b"], np.matmul(w["outb"].T, p)[::-1])
        return loss, g

    def fit(self, windows: np.ndarray, truth: np.ndarray, share: np.ndarray, epochs: int, lanes: int = 64, rate: float = 0.02, seed: int = 0) -> None:
        """Adam steps over shuffled windows (n, T), each with its share of its text."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        total, step = epochs * -(-len(windows) // lanes), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), lanes):
                pick = order[i : i + lanes]
                _, g = self.gradients(np.ascontiguousarray(windows[pick].T).astype(np.int64), truth[pick], share[pick])
                step += 1
                now = rate * (1 - (step - 1) / total)
                for k, w in self.weights.items():
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.01 * (np.square(g[k]) - second[k])
                    w -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def cut_windows(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows (n, steps) of byte ids, padded; the text of each window): all bytes of all texts."""
    counts = np.array([-(-len(t) // steps) for t in texts], np.int64)
    grid = np.full((int(counts.sum()), steps), PAD, np.int16)
    row = 0
    for t, n in zip(texts, counts.tolist()):
        whole = grid[row : row + n].reshape(-1)
        whole[: len(t)] = np.frombuffer(t, np.uint8)
        row += n
    return grid, np.repeat(np.arange(len(texts)), counts)


def places(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Rows to take of each language: equally many, and what a small language leaves open goes to the larger ones."""
    out = {}
    for i, name in enumerate(sorted(sizes, key=lambda n: (sizes[n], n))):
        out[name] = min(sizes[name], (most - sum(out.values())) // (len(sizes) - i))
    return out


def sample(docs: DataFrame, learn: Column, text: str, lang: str, key: str, sample_rows: int) -> DataFrame | None:
    """(text, lang, key): at most ``sample_rows`` rows for which ``learn`` holds, equally many per language but for languages
    that have fewer (places), each language's rows in hash order of key and text; None without such rows. More languages
    than sample rows are an error.
    """
    rows = docs.where(learn).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    hashed = F.pmod(F.xxhash64(key, text), F.lit(1_000_003)) / 1_000_003.0
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"), hashed.alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).limit(sample_rows + 1).collect()
    if not sizes:
        return None
    if len(sizes) > sample_rows:
        raise ValueError(f"more than {sample_rows} languages")
    quota = places({r["lang"]: r["n"] for r in sizes}, sample_rows)
    # Thinning leaves each language its places and some to spare; the window then takes exactly the places.
    shares = [(r["lang"], quota[r["lang"]], max(r["low"], (1.5 * quota[r["lang"]] + 50) / r["n"])) for r in sizes]
    table = docs.sparkSession.createDataFrame(shares, "lang string, quota long, share double")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "text"))
    thinned = rows.join(F.broadcast(table), "lang").where("h <= share").withColumn("place", place)
    return thinned.where(F.col("place") <= max(quota.values())).where("place <= quota").select("text", "lang", "key")


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 1600, size: int = 8, steps: int = 128, epochs: int = 1) -> Network | None:
    """A network fitted to a bounded and balanced sample of the rows for which ``learn`` holds (sample), to the whole text of
    each in windows as long as those that are scored, so weighed that every text counts the same; None without such rows.
    """
    chosen = sample(docs, learn, text, lang, key, sample_rows)
    if chosen is None:
        return None

    def fit(batches):
        got = sorted((r["key"], r["lang"], r["text"]) for b in batches for r in b.to_pylist())
        labels = sorted({r[1] for r in got})
        windows, owner = cut_windows([body.encode() for _, _, body in got], steps)
        network = Network(labels, size)
        if len(windows):
            network.fit(windows, np.array([labels.index(label) for _, label, _ in got])[owner], 1 / np.bincount(owner)[owner], epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((labels, size, network.weights))])], names=["model"])

    row = chosen.repartition(1).mapInArrow(fit, "model binary").first()
    if row is None:
        return None
    labels, size, weights = pickle.loads(row["model"])
    network = Network(labels, size)
    network.weights = weights
    return network


def label_texts(network: Network, texts: list[bytes], steps: int = 128, lanes: int = 4096) -> np.ndarray:
    """(texts, labels): probabilities averaged over every byte; uniform for empty texts."""
    out = np.zeros((len(texts), len(network.labels)))
    grid, owner = cut_windows(texts, steps)
    full = grid[:, -1] != PAD
    for part in (np.flatnonzero(full), np.flatnonzero(~full)):
        for i in range(0, len(part), lanes):
            pick = part[i : i + lanes]
            ids = np.ascontiguousarray(grid[pick].T).astype(np.int64)
            p = network.position_probabilities(ids)
            if not full[pick[0]]:
                p *= (ids != PAD)[:, None, :]
            np.add.at(out, owner[pick], p.sum(0).T)
    lengths = np.array([len(t) for t in texts])
    out[lengths == 0] = 1 / max(1, len(network.labels))
    return out / np.maximum(lengths, 1)[:, None]


def identify(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id", unknown: str = "und", chunk_bytes: int = 1 << 19) -> DataFrame:
    """(key, lang_pred, score): the likeliest learned label of every whole text and its pooled probability.

    A text that is null or has no letter, and every text where there is no network, gets ``unknown`` and score 0. A very
    long text is run in windows like any other. Repeated rows give repeated results; an empty table none. Columns other than the key
    and the text are not read.
    """

    def read(batches):
        for batch in batches:
            texts = [(t or "").encode() if ok else b"" for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            names, scores, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= chunk_bytes):
                    size += len(texts[j])
                    j += 1
                p = label_texts(network, texts[i:j])
                names += [network.labels[k] for k in p.argmax(1)]
                scores += np.clip(p.max(1), 0, 1).tolist()
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "known", "lang_pred", "score"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), known.alias("known"))
    if network is None:
        return rows.select(F.col("id").alias(key), F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = dict(rows.dtypes)["id"]
    read_rows = rows.mapInArrow(read, f"id {kind}, known boolean, lang_pred string, score double")
    return read_rows.select(F.col("id").alias(key), F.when(F.col("known"), F.col("lang_pred")).otherwise(F.lit(unknown)).alias("lang_pred"), F.when(F.col("known"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))

"""Whole-text log-likelihoods from a gated recurrent language model.

A token is a lower-cased word or the end of the text. The network predicts the most frequent tokens through a
class-factored softmax, P(class | state) P(token | class, state), with classes of about the square root of their
number. One more class holds all other tokens, which share it by their smoothed counts over the whole training corpus; all
tokens never seen count as one. The state runs through a text from its start to its end, window after window.

Training is parallel stochastic gradient descent with averaged weights (McDonald et al. 2010; Zinkevich et al. 2010):
in every round each partition runs truncated backpropagation over another share of its own training texts, so that all of
them are learned from once, and the weights are averaged by token counts in a tree of tasks.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gru import run_back, run_states
from .simhash import LOWER
from .store import staged

END = b""  # no word is empty
SMOOTH = 0.1


class Vocabulary(NamedTuple):
    """Counts of the training corpus. ``table`` (word, c) holds all of them; ``head`` the words the network predicts, by falling count;
    ``known`` the counts of a bounded number of the most frequent words."""

    table: DataFrame
    tokens: int
    distinct: int
    head: list[bytes]
    known: dict[bytes, int]
    head_tokens: int


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def count_words(docs: DataFrame, learn: Column, text: str = "text", head: int = 2048, known: int = 200_000) -> Vocabulary:
    """Counts of all tokens of the rows for which ``learn`` holds. Whole bands of the most frequent words become known, at
    most ``known`` words, and the first ``head`` of them are predicted. Null and empty texts count an end, repeated rows
    count each, and without rows all counts are zero. Other columns are not read."""

    def read(batches):
        for batch in batches:
            found = Counter()
            for body in batch.column(0):
                found.update(split(body.as_py()))
            found[END] += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "c"])

    rows = docs.where(learn).select(F.col(text).cast("string").alias("text"))
    table = staged(rows.mapInArrow(read, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total = table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    band = F.floor(F.log2("c") * 16).cast("int")  # at most a thousand bands, whatever the size
    bands = table.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    sizes = np.cumsum([b["count"] for b in bands])
    fit = int(np.searchsorted(sizes, known, "right"))
    lowest = bands[fit - 1]["band"] if fit else 1 << 30
    top = sorted(table.where(band >= lowest).collect(), key=lambda r: (-r["c"], r["word"]))
    counts = {bytes(r["word"]): r["c"] for r in top}
    first = list(counts)[:head]
    return Vocabulary(table, total["n"] or 0, total["v"], first, counts, sum(counts[w] for w in first))


def class_starts(counts: list[int], most: int) -> list[int]:
    """First words of the classes of words in falling count: about ``most`` classes with equal shares of the counts' square roots,
    so that frequent words are in small classes and rare ones in large ones (Mikolov et al. 2011)."""
    mass = np.cumsum(np.sqrt(np.array(counts, np.float64)))
    if not len(mass):
        return []
    share = np.minimum((np.append(0.0, mass[:-1]) / mass[-1] * most).astype(np.int64), most - 1)
    return [0, *(np.flatnonzero(np.diff(share)) + 1).tolist()]


class Model:
    """Weights and the layout of classes. Ids: 0 to head - 1 the predicted tokens, head the shared class, head + 1 padding."""

    def __init__(self, counts: list[int], others: int, end: int, size: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = len(counts)
        self.n, self.end, self.size = n, end, size
        self.starts = class_starts(counts, max(1, math.ceil(0.7 * math.sqrt(n))))
        self.edges = [*self.starts, n]
        self.group = np.searchsorted(self.starts, np.arange(n + 1), "right").astype(np.int16) - 1
        self.group[n] = len(self.starts)
        mass = np.array([*(sum(counts[s:e]) for s, e in zip(self.edges, self.edges[1:])), others], np.float64) + SMOOTH
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.weights = {
            "table": draw(3 * size, n + 2, by=0.1), "inner": draw(3 * size, size, by=size**-0.5),
            "classes": draw(len(mass), size, by=0.02), "class_bias": np.log(mass / mass.sum()).astype(np.float32)[:, None],
            "words": draw(n, size, by=0.02), "word_bias": np.log(np.array(counts, np.float64) + SMOOTH).astype(np.float32)[:, None],
        }

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, back: dict | None = None) -> np.ndarray:
        """Natural logs of P(target | state) for states (H, M); targets in the shared class get the log of the class.

        With ``back``, also the gradients of the summed negative logs, and under "states" those of the states.
        """
        w, m = self.weights, np.arange(len(targets))
        order = np.argsort(self.group[targets], kind="stable")
        states, targets = np.ascontiguousarray(states[:, order]), targets[order]
        group = self.group[targets]
        edges = np.searchsorted(group, np.arange(len(self.starts) + 1)).tolist()

        def softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, right: np.ndarray, at: np.ndarray):
            """Logs of the right rows' shares; p is left as the gradient of the scores."""
            p = weights @ h
            p += bias
            p -= p.max(0)
            mine = p[right, at]
            np.exp(p, out=p)
            total = p.sum(0)
            if back is not None:
                p /= total
                p[right, at] -= 1
            return mine - np.log(total), p

        out, p = softmax(w["classes"], w["class_bias"], states, group, m)
        out = out.astype(np.float64)
        if back is not None:
            back["classes"], back["class_bias"], d_states = p @ states.T, p.sum(1, keepdims=True), w["classes"].T @ p
            back["words"], back["word_bias"] = np.zeros_like(w["words"]), np.zeros_like(w["word_bias"])
        for s, e, a, b in zip(self.edges, self.edges[1:], edges, edges[1:]):
            if a < b and e - s > 1:  # a word alone in its class has share one
                h = states[:, a:b]
                logs, p = softmax(w["words"][s:e], w["word_bias"][s:e], h, targets[a:b] - s, m[: b - a])
                out[a:b] += logs
                if back is not None:
                    back["words"][s:e], back["word_bias"][s:e] = p @ h.T, p.sum(1, keepdims=True)
                    d_states[:, a:b] += w["words"][s:e].T @ p
        if back is not None:
            back["states"] = np.empty_like(states)
            back["states"][:, order] = d_states
        result = np.empty_like(out)
        result[order] = out
        return result

    def score(self, texts: list[np.ndarray], steps: int = 16, lanes: int = 512) -> np.ndarray:
        """Summed natural logs of each sequence of ids; the state is carried from window to window. Texts of like lengths run
        side by side."""
        out = np.zeros(len(texts))
        order = np.argsort([len(t) for t in texts], kind="stable")[::-1]
        for i in range(0, len(order), lanes):
            pick = order[i : i + lanes]
            out[pick] = self._score_lanes([texts[j] for j in pick], steps)
        return out

    def _score_lanes(self, texts: list[np.ndarray], steps: int) -> np.ndarray:
        """``texts`` are in falling length."""
        out, pad = np.zeros(len(texts)), self.n + 1
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([x for t in texts for x in ((self.end,), t)] + [np.full(steps + 1, pad)]).astype(np.int32)
        base = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        state = np.zeros((self.size, len(texts)), np.float32)
        for first in range(0, int(lengths.max(initial=0)), steps):
            lanes = int(np.searchsorted(-lengths, -first))
            at = first + np.arange(min(steps, int(lengths[0]) - first))[:, None]
            real = at < lengths[:lanes]
            where = np.minimum(base[:lanes] + at, len(flat) - 2)
            ids, after = np.where(real, flat[where], pad), flat[where + 1]
            states = run_states(ids, self.weights["table"], self.weights["inner"], pad, None, state[:, :lanes])
            state = states[-1]
            logs = self.log_probabilities(np.ascontiguousarray(states.transpose(1, 0, 2)[:, real]), after[real])
            out[:lanes] += np.bincount(np.nonzero(real)[1], logs, lanes)
        return out

    def train(self, texts: list[np.ndarray], rate: float, steps: int = 24, lanes: int = 256) -> int:
        """One pass of truncated backpropagation with Adagrad steps; returns the number of tokens.

        The texts follow each other, a pad before each, in lanes of equal length, so that every window is full however
        long or short they are; a text that a lane's end cuts goes on in the next lane from a fresh state.
        """
        w, pad = self.weights, self.n + 1
        seen = {k: np.full_like(v, 1e-4) for k, v in w.items()}
        total = sum(map(len, texts))
        flat = np.concatenate([x for t in texts for x in ((pad, self.end), t)]).astype(np.int32)
        lanes = max(1, min(lanes, total // (4 * steps)))
        reach = -(-(len(flat) - 1) // lanes)
        flat = np.append(flat, np.full(reach * lanes + 1 - len(flat), pad, np.int32))
        rows = np.lib.stride_tricks.sliding_window_view(flat, reach + 1)[::reach]
        state = None
        for first in range(0, reach, steps):
            part = np.ascontiguousarray(rows[:, first : first + steps + 1].T)
            ids, after = part[:-1], part[1:]
            real = (after != pad) & (ids != pad)
            n = int(real.sum())
            if not n:
                continue
            tape: list = []
            states = run_states(ids, w["table"], w["inner"], pad, tape, state)
            state, g = states[-1], {}
            self.log_probabilities(states.transpose(1, 0, 2)[:, real], after[real], g)
            d = np.zeros(states.shape, np.float32)
            d.transpose(1, 0, 2)[:, real] = g.pop("states")
            g["table"], g["inner"] = run_back(ids, w["inner"], pad, tape, d)
            for k, grad in g.items():
                grad *= np.float32(1 / n)
                seen[k] += np.square(grad)
                grad *= np.float32(rate)
                grad /= np.sqrt(seen[k])
                w[k] -= grad
        return total


def new_model(vocabulary: Vocabulary, size: int) -> Model:
    counts = [vocabulary.known[w] for w in vocabulary.head]
    end = vocabulary.head.index(END) if END in vocabulary.head else len(counts)
    return Model(counts, vocabulary.tokens - vocabulary.head_tokens, end, size)


def _average(df: DataFrame, fan_in: int = 16) -> dict | None:
    """Token-weighted mean of the rows (tokens, weights times tokens), added up in a tree of tasks that hold one sum each."""

    def add(batches):
        total, sums = 0, {}
        for batch in batches:
            for row in batch.column(0):
                tokens, weights = pickle.loads(row.as_py())
                total += tokens
                sums = {k: sums.get(k, 0) + v for k, v in weights.items()}
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((total, sums))], pa.binary())], names=["state"])

    rows = df.count()
    while rows > 1:
        rows = -(-rows // fan_in)
        df = df.repartition(rows).mapInArrow(add, "state binary")
    row = df.first()
    if row is None:
        return None
    total, sums = pickle.loads(row["state"])
    return {k: v / np.float32(total) for k, v in sums.items()}


def fit(docs: DataFrame, learn: Column, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", size: int = 16, rounds: int = 4, rate: float = 0.5) -> Model:
    """A model trained on every text for which ``learn`` holds, once each, in ``rounds`` rounds; in each, every partition
    learns from another part of its texts, by a hash of key and text.

    Null and empty texts teach the end alone, repeated rows count each, rows with a null key are dealt by their text, and
    without rows the model stays as it begins. A very long text fills the same windows as short ones. The weights depend on
    how the input is split into partitions, since each partition's steps are averaged with the others'.
    """
    model = new_model(vocabulary, size)
    if not vocabulary.head:
        return model
    index = {w: i for i, w in enumerate(vocabulary.head)}
    rows = docs.where(learn).select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(key, text), F.lit(rounds)).alias("turn"))
    for turn in range(rounds):

        def learn_part(batches, model=model, turn=turn):
            texts = []
            for batch in batches:
                for body in batch.column(0):
                    words = [*split(body.as_py()), END]
                    texts.append(np.fromiter(map(index.get, words, repeat(model.n)), np.int32, len(words)))
            if texts:
                tokens = model.train(texts, rate / (1 + turn))
                state = pickle.dumps((tokens, {k: w * np.float32(tokens) for k, w in model.weights.items()}))
                yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

        trained = staged(rows.where(F.col("turn") == turn).select("text").mapInArrow(learn_part, "state binary"), "weights")
        model.weights = _average(trained) or model.weights
    return model


def score(docs: DataFrame, model: Model, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", at_once: int = 1024) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole text.

    ``base_score`` is that of a unigram model with 0.1 added to every count, ``score`` the network's, which shares the
    same events: known tokens and one event for all others. Words whose counts are not among the bounded
    number that every task holds meet the full table of counts in a join, one row per text and word. Null and empty texts
    hold the end alone. Repeated rows are scored each. Without training texts both scores are zero. Very long texts
    run through the same windows. An empty table gives an empty result. Other columns are not read.
    """
    rank = {w: i for i, w in enumerate(vocabulary.known)}  # the predicted words come first
    others = vocabulary.tokens - vocabulary.head_tokens
    types = vocabulary.distinct - len(vocabulary.head)
    logs = np.log10(np.array([*vocabulary.known.values(), 0], np.float64) + SMOOTH)  # the last is never asked for
    whole = math.log10(vocabulary.tokens + SMOOTH * (vocabulary.distinct + 1))
    shared = math.log10(others + SMOOTH * (types + 1))
    complete = len(rank) == vocabulary.distinct

    def look_up(bodies: pa.Array):
        """(tokens, known ones, base, what the shared class adds, unknown words with counts, ids) of each text."""
        words, ends = [], []
        for body in bodies:
            words += split(body.as_py())
            words.append(END)
            ends.append(len(words))
        place = np.fromiter(map(rank.get, words, repeat(-1)), np.int32, len(words))
        starts, known = np.array([0, *ends[:-1]]), place >= 0
        seen = np.where(known, logs[place], 0.0)
        ids = np.where(known & (place < model.n), place, np.int32(model.n))
        low = ids == model.n
        sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731 (every text has a token)
        rest = [Counter() for _ in ends]
        unknown = np.flatnonzero(~known)
        for i, t in zip(unknown.tolist(), np.searchsorted(ends, unknown, "right").tolist()):
            rest[t][words[i]] += 1
        rest = [[{"word": w, "n": n} for w, n in r.items()] for r in rest]
        return np.diff([0, *ends]), sums(known.astype(np.int64)), sums(seen), sums(np.where(low, seen - shared, 0.0)), rest, np.split(ids, ends[:-1])

    def read(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [look_up(batch.column(1).slice(i, at_once)) for i in range(0, len(batch), at_once)]
            if not found:
                continue
            n_tokens, n_known, base, tail = (np.concatenate([f[c] for f in found]) for c in range(4))
            scores = model.score([t for f in found for t in f[5]]) / math.log(10) + tail
            rest = pa.array([r for f in found for r in f[4]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            columns = pa.array(number + np.arange(len(batch))), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(scores), rest
            number += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "row", "n_tokens", "n_known", "base", "score", "rest"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    read_rows = rows.mapInArrow(read, f"id {dict(rows.dtypes)['id']}, row long, n_tokens long, n_known long, base double, score double, rest array<struct<word: binary, n: long>>")
    lone = F.lit(math.log10(SMOOTH))
    if complete:
        unseen = F.expr("aggregate(rest, 0L, (s, x) -> s + x.n)")
        done = read_rows.withColumns({"base": F.col("base") + unseen * lone, "score": F.col("score") + unseen * lone})
    else:
        first = F.col("pos").isNull() | (F.col("pos") == 0)
        spread = read_rows.select("id", "row", "n_tokens", "n_known", "base", "score", F.posexplode_outer("rest").alias("pos", "part"))
        spread = spread.select("id", "row", *[F.when(first, F.col(c)).alias(c) for c in ("n_tokens", "n_known", "base", "score")], F.col("part.word").alias("word"), F.col("part.n").alias("n"))
        met = spread.join(vocabulary.table, "word", "left")
        gain = F.col("n") * F.when(F.col("c").isNull(), lone).otherwise(F.log10(F.col("c") + SMOOTH))
        known = F.when(F.col("c").isNotNull(), F.col("n"))
        done = met.groupBy("row", "id").agg(
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.coalesce(F.sum(known), F.lit(0))).alias("n_known"),
            (F.sum("base") + F.coalesce(F.sum(gain), F.lit(0.0))).alias("base"),
            (F.sum("score") + F.coalesce(F.sum(gain), F.lit(0.0))).alias("score"),
        )
    base = F.col("base") - F.col("n_tokens") * whole
    return done.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

Brin et al., "Dynamic Itemset Counting and Implication Rules" (1997). The corpus is dealt over a few shards, which are scanned in
turn, round and round. A word counts from the first scan on; a longer phrase counts from the scan after the one in which
both its sub phrases, without its last and without its first word, have reached the threshold, and for as many scans as there are
shards, so once over every shard. Counters are keyed by hashes, and scans read hashed words. Which sub phrases have reached the threshold, and in which
scan, is told by an array of a fixed number of slots (a gate), and a phrase's cycle follows from its sub phrases' slots alone: a
slot that two phrases share only opens longer phrases too soon. A last cycle counts the phrases that ended at or above the
threshold by their text, so hashes select candidates and no count rests on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import column, discard, scratch, staged_at

#: What ends a piece (blanks and tabs part words), and A-Z in lower case.
ENDS = ".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans((ENDS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), ("." * len(ENDS) + "abcdefghijklmnopqrstuvwxyz").encode())
NEVER = 255
GATE_BITS = 24  # slots of a gate, one byte each
KEEP_BITS = 26  # slots of the survivors of one length, one bit each
CHUNK = 1 << 19  # words whose phrases a task counts at a time by hash
HELD = 1 << 20  # and by text


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case; b"." stands between pieces, and is never a word."""
    return text.encode().translate(_PLAIN).replace(b".", b" . ").split()


class Hashes(dict):
    """32-bit hashes of one language's words, remembered up to a bound; 0 for the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh32_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh32_intdigest(word, self.seed) or 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CHUNK:
            self.clear()
            self[b"."] = 0
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring parts, in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def phrase_hashes(h: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes, whether no piece ends inside) of the phrases of 1 to ``longest`` words from each place on."""
    words = h.astype(np.uint64)
    out = [(_mix(words, words), h != 0)]
    for k in range(1, longest):
        before, whole = out[-1]
        n = max(0, len(h) - k)
        out.append((_mix(before[:n], words[k:]), whole[:n] & (h[k:] != 0)))
    return out


def _keyed(h: np.ndarray, size: int) -> np.ndarray:
    """Counter keys: a hash with the phrase's length in its lowest two bits."""
    return ((h & ~np.uint64(3)) | np.uint64(size)).view(np.int64)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).view(np.int64)


def starts(h: np.ndarray, longest: int, gates: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, whole, first scan) for each length; the first scan is NEVER + 1 or more where a sub phrase has not reached the threshold."""
    found, out = phrase_hashes(h, longest), []
    for k, (hashes, whole) in enumerate(found):
        if k == 0:
            first = np.zeros(len(hashes), np.int64)
        else:  # sub phrases start at the same place and at the next
            opened = gates[k - 1][_slots(found[k - 1][0], len(gates[k - 1]).bit_length() - 1)].astype(np.int64)
            first = 1 + np.maximum(opened[: len(hashes)], opened[1 : len(hashes) + 1])
        out.append((hashes, whole, first))
    return out


def _counted(keys: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, first = keys[order], first[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(heads, len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(keys[heads]), pa.array(counts), pa.array(np.maximum.reduceat(first, heads).astype(np.int32))], names=["key", "n", "start"])


def _hashed(docs: DataFrame) -> DataFrame:
    """(lang, words, shard) of (lang, body, shard): the words' hashes, as bytes of unsigned 32-bit numbers."""

    def run(batches):
        known: dict[str, Hashes] = {}
        for batch in batches:
            out = []
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = known if lang in known or len(known) < 256 else {}
                out.append(known.setdefault(lang, Hashes(lang)).of(words_of(body.as_py())).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["lang", "words", "shard"])

    return docs.mapInArrow(run, "lang string, words binary, shard int")


def _scan(texts: DataFrame, step: int, shards: int, longest: int, gates) -> DataFrame:
    """(key, n, start) of the phrases of a shard whose cycle holds this scan, from (lang, words)."""
    end = np.zeros(1, np.uint32).tobytes()

    def count(parts):
        keys, firsts = [], []
        for size, (hashes, whole, first) in enumerate(starts(np.frombuffer(end.join(parts), "<u4"), longest, gates.value), 1):
            now = whole & (first <= step) & (step < first + shards)
            keys.append(_keyed(hashes[now], size))
            firsts.append(first[now])
        joined = np.concatenate(keys)
        return [_counted(joined, np.concatenate(firsts))] if len(joined) else []

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for words in batch.column(0):
                held.append(words.as_py())
                size += len(held[-1]) // 4
                if size >= CHUNK:
                    yield from count(held)
                    held, size = [], 0
        if held:
            yield from count(held)

    return texts.select("words").mapInArrow(run, "key long, n long, start int")


class Numbers(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found


def _counts_by_text(lang: str, numbers: Numbers, ids: np.ndarray, longest: int, keep: list[np.ndarray]):
    """Record batches of the survivors' counts: by the numbers of their words, so that a text is made once for all its places."""
    h = Hashes(lang).of(numbers.words)[ids]
    words = [w.decode() for w in numbers.words]
    yield [""], 0, [int((ids != 0).sum())]
    for k, (hashes, whole) in enumerate(phrase_hashes(h, longest)):
        slot = _slots(hashes, len(keep[k]).bit_length() + 2)
        at = np.flatnonzero(whole & ((keep[k][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool))
        code = ids[at].astype(np.int64)
        for j in range(1, k + 1):
            if j > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code << 31 | ids[at + j]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        parts = [[words[i] for i in ids[at[first] + j].tolist()] for j in range(k + 1)]
        yield parts[0] if k == 0 else list(map(" ".join, zip(*parts))), k + 1, counts


def _exact(docs: DataFrame, longest: int, keep) -> DataFrame:
    """(lang, phrase, size, n) of the survivors, and of all words together, under size 0, from (lang, body)."""

    def flush(held: dict):
        for lang, (numbers, parts) in held.items():
            for names, size, counts in _counts_by_text(lang, numbers, np.concatenate(parts), longest, keep.value):
                if len(names):
                    columns = [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(np.full(len(names), size, np.int32)), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])
        held.clear()

    def run(batches):
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(body.as_py())
                numbers, parts = held.setdefault(lang, (Numbers(), []))
                parts += [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                size += len(words)
                if size >= HELD:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return docs.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _slot_bits(counts: DataFrame) -> dict[tuple[bool, int], np.ndarray]:
    """The slots of (key, ended, fresh): of the phrases that have ended, and of those that have just reached the threshold, by (ended, size): arrays of
    bits, little end first, of fixed sizes, which reach the driver in pages of 4 KB."""
    slot = lambda ended, bits: F.when(F.col("ended" if ended else "fresh"), F.struct(F.lit(ended).alias("ended"), F.shiftrightunsigned("key", 64 - bits).alias("slot")))
    both = F.explode(F.array_compact(F.array(slot(True, KEEP_BITS), slot(False, GATE_BITS)))).alias("s")
    rows = counts.where("ended OR fresh").select(F.col("key").bitwiseAND(F.lit(3)).alias("size"), both).select("size", "s.ended", F.shiftright("s.slot", 15).alias("page"), F.col("s.slot").bitwiseAND(F.lit(32767)).alias("at"))
    out: dict[tuple[bool, int], np.ndarray] = {}
    for r in rows.groupBy("ended", "size", "page").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        bits = out.setdefault((r["ended"], r["size"]), np.zeros(1 << ((KEEP_BITS if r["ended"] else GATE_BITS) - 3), np.uint8))
        bits[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def mine(docs: DataFrame, longest: int = 3, least: int = 10, shards: int = 2, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(lang, phrase, size, n): every phrase of 1 to ``longest`` words (3 at most) that occurs ``least`` times in its language, with
    its number of occurrences, and all words of each language under the empty phrase and size 0.

    Texts (null: empty) are in lower case for A-Z, end in pieces at ENDS, and pieces in words at blanks and tabs; phrases lie
    inside pieces and may overlap. A null language is `und`. Rows that repeat count each; keys only deal the rows over shards. An
    empty table gives an empty result. Other columns are not read.

    Scans end when no phrase can still be within its cycle. The counters of a scan meet those of the scans before in one
    aggregation, which is written to the shared folder; what has ended below the threshold is left out. The gates, one byte a slot,
    and the survivors, one bit a slot, are arrays of a fixed size, whatever the corpus: as they fill, fewer phrases are ruled out
    before they are counted, and no count changes.
    """
    if not 1 <= longest <= 3:
        raise ValueError("phrases have 1 to 3 words")
    spark = docs.sparkSession
    body, name = F.coalesce(column(text).cast("string"), F.lit("")), F.coalesce(column(lang).cast("string"), F.lit("und"))
    home = scratch(spark, "texts")
    rows = docs.select(name.alias("lang"), body.alias("body"))
    dealt = docs.select(name.alias("lang"), body.alias("body"), F.pmod(F.xxhash64(column(key), body), F.lit(shards)).cast("int").alias("shard"))
    _hashed(dealt).write.partitionBy("shard").parquet(home)
    corpus = spark.read.schema("lang string, words binary, shard int").parquet(home)
    gates = [np.full(1 << GATE_BITS, NEVER, np.uint8) for _ in range(longest - 1)]
    keep = [np.zeros(1 << (KEEP_BITS - 3), np.uint8) for _ in range(longest)]
    state, place, step, last = None, None, 0, shards - 1
    while step <= last:
        sent = spark.sparkContext.broadcast(gates)
        now = _scan(corpus.where(F.col("shard") == step % shards), step, shards, longest, sent)
        parts = now.withColumn("old", F.lit(0).cast("long"))
        if state is not None:
            parts = parts.unionByName(state.select("key", "n", "start", F.col("n").alias("old")))
        merged = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("start").alias("start"), F.sum("old").alias("old"))
        ended = F.col("start") + shards <= step + 1
        merged = merged.withColumns({"ended": ended, "fresh": (F.col("n") >= least) & (F.col("old") < least)}).drop("old")
        table, there = staged_at(merged.where(~F.col("ended") | (F.col("n") >= least)), f"counts{step}")
        sent.destroy()
        for (done, size), bits in _slot_bits(table).items():
            if done:
                keep[size - 1] |= bits
            elif size < longest:
                opened = np.unpackbits(bits, bitorder="little").view(bool) & (gates[size - 1] == NEVER)
                gates[size - 1][opened] = step
                last = max(last, step + shards)
        if place:
            discard(spark, place)
        state, place, step = table.where("NOT ended"), there, step + 1
    discard(spark, place)
    discard(spark, home)
    sent = spark.sparkContext.broadcast(keep)
    exact, _ = staged_at(_exact(rows, longest, sent).where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")
    sent.destroy()
    return exact


def _cuts(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each phrase of two words and more, by its lowest-scoring cut."""
    known = lambda side: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0]))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    every = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), cut)
    every = every.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    both = every.join(known("left"), ["lang", "left"]).join(known("right"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = both.withColumns({"x": wide("a") * wide("a") * 1_000_000, "y": wide("l") * wide("r")}).withColumn("score", F.expr("x div y"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return score.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, most: int = 2000, shards: int = 2, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` strongest phrases of each language (mine).

    Phrases of 2 to ``longest`` words with a >= ``least`` occurrences are candidates. A candidate is cut after its first k words where
    floor(1000000 a a / (l r)) is least, l and r the counts of both parts, ties to the smallest k. One whose words lie in a longer
    candidate with at least ``share`` percent of its count is dropped. Sorted by falling score and a, then by phrase in the order of its
    bytes; n are all words of the language. Products are exact up to 38 digits. Languages without a candidate, empty
    tables and texts without words give no rows.
    """
    counts = mine(docs, longest, least, shards, text, lang, key)
    scored = _cuts(counts, longest)
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))")
    longer = scored.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("by")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("by").isNull() | (100 * F.col("by") < share * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place).where(F.col("rank") <= most)  # a constant bound, so that ranks are pruned before the shuffle
    words = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

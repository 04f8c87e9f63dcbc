"""Repeated passages: documents stream through suffix automata of the reference passages.

A window is a run of ``width`` words. The work has four steps, all keyed and none over all pairs:

1. Anchors. A window's anchor is the smallest hash among its word k-grams, so equal windows have equal anchors, and a text has
   few of them. An anchor that only one document has rules its windows out.
2. Owners. The windows left are hashed and meet by hash, in groups whose number grows with the text; the smallest document
   with a window owns it. Windows that only their owner has are ruled out.
3. Automata. The windows that a document owns for others are its reference passages. Passages of other documents
   stream through the suffix automaton of their owner's, a reference shard that is sent wherever it is needed once; equal
   passages stream once, and the many passages of one owner are dealt over copies of its automaton. Matching statistics over
   the words themselves give the maximal spans that are repeated, so nothing is removed for equal hashes of unequal words. A repeat
   is missed only if another window of a smaller document has the same 64-bit hash: of n different windows a share of n / 2^64.
4. Removal. The spans return to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .store import partitions, staged

BROADCAST_BYTES = 64 << 20
SHARD_BYTES = 16 << 20  # text whose windows meet in one group
PIECE_BYTES = 256 << 10  # passages that stream through one copy of an owner's automaton


class SuffixAutomaton:
    """All substrings of a sequence of references given in turn, with separators that match nothing (Blumer et al. 1985)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.breaks = [-1], [0], 0, 0

    def add(self, words: list[bytes]) -> None:
        self.breaks += 1
        for word in (*words, self.breaks):
            following, link, length = self.next, self.link, self.length
            new = len(length)
            length.append(length[self.last] + 1)
            following.append({})
            link.append(0)
            p = self.last
            while p >= 0 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p >= 0:
                q = following[p][word]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    following.append(dict(following[q]))
                    link.append(link[q])
                    while p >= 0 and following[p].get(word) == q:
                        following[p][word] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            self.last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest run of words ending there that the references hold."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            out.append(matched)
        return out


def maximal_spans(matched: list[int], width: int) -> list[tuple[int, int]]:
    """Word ranges covered by matches of at least ``width`` words."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(matched):
        if n >= width:
            start = i + 1 - n
            if out and start <= out[-1][1]:
                out[-1] = min(out[-1][0], start), i + 1
            else:
                out.append((start, i + 1))
    return out


def _windows(data, offsets, width: int, k: int):
    """(text of each window, place in it, anchor, word hashes, word number) of all windows of a run of texts."""
    starts, ends, first = spans.words(data, offsets)
    hashes = spans.word_hashes(data, starts, ends)
    n = len(hashes) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), hashes, np.empty(0, np.int64))
    at = np.arange(len(hashes) - k + 1)
    low, reach, m = spans.range_hashes(hashes, at, at + k), 1, width - k + 1
    while 2 * reach <= m:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < m:
        low = np.minimum(low[: n], low[m - reach :][: n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(text[:n] == text[width - 1 :])
    return text[whole], whole - first[text[whole]], low[whole], hashes, whole


def _mark(values: np.ndarray) -> np.ndarray:
    """31 bits of a text's hash above a place in the text: texts that share a key stay apart."""
    return (values.astype(np.int64) & 0x7FFFFFFF) << 32


def _join(docs: DataFrame, lists: DataFrame, size: int, how: str) -> DataFrame:
    """Bring per-document lists to their texts: by broadcast up to BROADCAST_BYTES, else by a shuffle of both."""
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "id", how)


def _packed(key: np.ndarray, parts: int, columns: list[np.ndarray], names: list[str]):
    """One row for each remainder of ``key``, with the columns as bytes."""
    shard = (key.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(parts + 1))
    to = np.flatnonzero(np.diff(cuts))
    if len(to):
        values = [pa.array([c[order[cuts[s] : cuts[s + 1]]].tobytes() for s in to], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(to), *values], names=names)


def repeated_runs(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(id, marks, starts, stops, owners): runs of windows of a document whose hashes another document shares.

    ``rows`` has (id, text, mark). Starts and stops are the first windows of a run's first and after its last.
    """
    def anchors(batches):
        for batch in batches:
            found = []
            for _, data, offsets in spans.chunks(batch.column(1)):
                text, _, anchor, _, _ = _windows(data, offsets, width, k)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                found += [np.unique(anchor[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "anchors"])

    held = staged(rows.select("id", "text").mapInArrow(anchors, "id long, anchors array<long>").where("size(anchors) > 0"), "anchors")
    each = held.select("id", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    lists = staged(each.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "shared")
    size = lists.agg(F.coalesce(F.sum(F.size("anchors") * 8 + 24), F.lit(0))).first()[0]

    def windows(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for row, data, offsets in spans.chunks(batch.column(1), 1 << 22):
                text, place, anchor, hashes, whole = _windows(data, offsets, width, k)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                keep = [np.isin(anchor[a:b], batch.column(3)[row + i].values.to_numpy().view(np.uint64)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                keep = np.concatenate(keep) if keep else np.empty(0, bool)
                text, place, whole = text[keep] + row, place[keep], whole[keep]
                window = spans.range_hashes(hashes, whole, whole + width)
                yield from _packed(window, parts, [window, ids[text], _mark(marks[text]) | place], ["shard", "window", "id", "at"])

    def owners(groups):
        for (_, *columns) in groups:
            window, ids, at = columns
            order = np.lexsort((ids, window))
            window, ids, at = window[order], ids[order], at[order]
            new = np.concatenate(([True], window[1:] != window[:-1]))[: len(window)]
            group = np.cumsum(new) - 1
            lowest = ids[new]
            highest = ids[np.append(np.flatnonzero(new)[1:], len(ids)) - 1]
            pick = (highest > lowest)[group]
            yield from _packed(spans.mix(ids[pick].view(np.uint64)), parts, [ids[pick], at[pick], lowest[group][pick]], ["shard", "id", "at", "owner"])

    def runs(groups):
        for (_, *columns) in groups:
            grid = np.unique(np.stack(columns, 1), axis=0)
            ids, at, owner = grid.T
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(ids)) - 1
            name = ids[first]
            cuts = np.append(np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)]), len(name))
            part = lambda v: pa.array([v[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64()))
            columns = [at[first] >> 32, at[first] & 0xFFFFFFFF, (at[last] & 0xFFFFFFFF) + 1, owner[first]]
            yield pa.RecordBatch.from_arrays([pa.array(name[cuts[:-1]]), *map(part, columns)], names=["id", "marks", "starts", "stops", "owners"])

    near = _join(rows, lists, size, "inner").select("id", "text", "mark", "anchors")
    held_bytes = rows.join(F.broadcast(lists.select("id")) if size <= BROADCAST_BYTES else lists.select("id"), "id", "left_semi").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(rows.sparkSession), -(-held_bytes // SHARD_BYTES))
    met = near.mapInArrow(windows, "shard long, window binary, id binary, at binary")
    owned = _by_shard(met, owners, ["<u8", "<i8", "<i8"], "shard long, id binary, at binary, owner binary")
    return staged(_by_shard(owned, runs, ["<i8"] * 3, "id long, marks array<long>, starts array<long>, stops array<long>, owners array<long>"), "runs")


def _by_shard(packed: DataFrame, work, kinds: list[str], schema: str) -> DataFrame:
    """Apply ``work`` to each shard's unpacked columns."""

    def whole(groups):
        def unpacked():
            for batch in groups:
                if len(batch):
                    yield (batch.column(0)[0].as_py(), *(np.concatenate([np.frombuffer(x, t) for x in batch.column(i + 1).to_pylist()]) for i, t in enumerate(kinds)))

        yield from work(unpacked())

    def one(table: pa.Table) -> pa.Table:
        out = list(whole([table.combine_chunks()]))
        return pa.Table.from_batches(out) if out else None

    empty = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in packed.sparkSession.createDataFrame([], schema).schema])
    return packed.groupBy("shard").applyInArrow(lambda table: one(table) or empty.empty_table(), schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[kind]


def repeated_spans(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(id, spans): the word ranges of a text, with its mark, that lie in windows of a document with a smaller id."""
    runs = repeated_runs(rows, width, k)
    size = runs.agg(F.coalesce(F.sum(F.size("starts") * 32 + 40), F.lit(0))).first()[0]

    def passages(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for r in batch.to_pylist():
                words = None
                for mark, start, stop, owner in zip(r["marks"], r["starts"], r["stops"], r["owners"]):
                    if mark == r["mark"] & 0x7FFFFFFF:
                        words = (r["text"] or "").encode().split() if words is None else words
                        body = b" ".join(words[start : stop + width - 1])
                        for column, value in zip(out, (r["id"], mark, start, owner, owner == r["id"], hashlib.blake2b(body, digest_size=16).digest(), body)):
                            column.append(value)
            types = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "mark", "start", "owner", "reference", "digest", "body"])

    def match(batches):
        copy, automaton = None, None
        for batch in batches:
            out = [[] for _ in range(3)]
            for r in batch.to_pylist():
                owner = r["owner"]
                if (owner, r["piece"]) != copy:
                    copy, automaton = (owner, r["piece"]), SuffixAutomaton()
                words = r["body"].split(b" ")
                if r["reference"]:
                    automaton.add(words)
                else:
                    found = maximal_spans(automaton.matching(words), width)
                    for column, value in zip(out, (owner, r["digest"], [{"a": a, "b": b} for a, b in found])):
                        column.append(value)
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pair))], names=["owner", "digest", "found"])

    cut = staged(_join(rows, runs, size, "inner").select("id", "text", "mark", "marks", "starts", "stops", "owners").mapInArrow(passages, "id long, mark long, start long, owner long, reference boolean, digest binary, body binary"), "passages")
    streams = cut.where("not reference")
    once = cut.groupBy("owner", "reference", "digest").agg(F.first("body").alias("body"))
    pieces = once.where("not reference").groupBy("owner").agg(F.ceil(F.sum(F.octet_length("body")) / PIECE_BYTES).cast("int").alias("pieces"))
    mine = F.array(F.pmod(F.xxhash64("digest"), "pieces").cast("int"))
    dealt = once.join(pieces, "owner").withColumn("piece", F.explode(F.when(F.col("reference"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(mine)))
    order = ["owner", "piece", F.desc("reference"), "digest"]
    matched = dealt.select("owner", "piece", "reference", "digest", "body").repartition(partitions(rows.sparkSession), "owner", "piece").sortWithinPartitions(*order).mapInArrow(match, "owner long, digest binary, found array<struct<a: long, b: long>>")
    back = streams.select("id", "mark", "start", "owner", "digest").join(matched, ["owner", "digest"]).select("id", "mark", "start", F.explode("found").alias("f"))
    return staged(back.groupBy("id").agg(F.collect_list(F.struct("mark", (F.col("start") + F.col("f.a")).alias("a"), (F.col("start") + F.col("f.b")).alias("b"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, width: int = 50, text: str = "text", key: str = "doc_id", k: int = 16, texts: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]): one row per input row.

    A word goes if a window of ``width`` words covers it whose words also start in a document with a smaller key; windows are
    judged on the input. ``kept`` holds the words left, joined by one space, and the digest is of it in UTF-8. Words are
    runs of anything but ASCII white space. Null and empty texts have no words. Rows with a null key are neither cut nor
    a reference. Rows that share a key do not count as smaller than each other. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    spans_of = repeated_spans(rows.where("id is not null"), width, k)
    size = spans_of.agg(F.coalesce(F.sum(F.size("spans") * 40 + 24), F.lit(0))).first()[0]

    def cut(batches):
        for batch in batches:
            ids, bodies, marks, found = (batch.column(i) for i in range(4))
            out = [[] for _ in range(4)]
            for body, mark, ranges in zip(bodies, marks.to_pylist(), found):
                words = body.as_py().encode().split()
                left = words
                mine = [r for r in ranges.as_py() or () if r["mark"] == mark & 0x7FFFFFFF]
                if mine:
                    gone = np.zeros(len(words), bool)
                    for r in mine:
                        gone[r["a"] : r["b"]] = True
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(left)
                for column, value in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)):
                    column.append(value)
            columns = [ids, *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))]
            names = ["id", "n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(columns[: 4 + texts], names=names[: 4 + texts])

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return _join(rows, spans_of, size, "left").select("id", "text", "mark", "spans").mapInArrow(cut, schema).withColumnRenamed("id", key)

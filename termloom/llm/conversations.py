"""Repair of conversations by their cheapest edits, with an audit of them.

A dynamic program over the rows of a conversation keeps, for each state of the wanted role order, the cheapest edits so far. Audits
that share a beginning share its nodes (Trails): every node knows its ancestors 2^k pieces up and a rolling hash of its whole
letters, so that the first difference of two audits is found by search. Long conversations are cut into pieces that are worked
on side by side, from every state on, and put together piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .store import partitions, staged

BLANKS = " \t\n\x0b\x0c\r"
PRIME, BASE = 10**18 + 9, 256
#: States of (s?(ua)+)?: nothing yet, after the first s, after a u, after an a. Nothing and after an a may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # what an inserted or a reroled row is in each state
ENDS = (0, 3)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
PIECE_ROWS = 2048
ROLES = {"u": "user", "a": "assistant"}


class Trails:
    """Growing strings that share their beginnings: a node is a piece of letters behind another node; node 0 is empty."""

    def __init__(self):
        self.piece, self.size, self.mark, self.deep, self.up = [b""], [0], [0], [0], [[]]

    def add(self, node: int, piece: bytes) -> int:
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.piece.append(piece)
        self.size.append(self.size[node] + len(piece))
        self.mark.append(self._grown(self.mark[node], piece))
        self.deep.append(self.deep[node] + 1)
        self.up.append(ups)
        return len(self.piece) - 1

    @staticmethod
    def _grown(mark: int, piece: bytes) -> int:
        return (mark * pow(BASE, len(piece), PRIME) + int.from_bytes(piece, "big")) % PRIME

    def _holding(self, node: int, n: int) -> int:
        """The ancestor, or the node, whose piece holds letter n, counted from 1."""
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.size[self.up[node][k]] >= n:
                node = self.up[node][k]
        return node

    def hash(self, node: int, n: int) -> int:
        """Of the first n letters."""
        if n == 0:
            return 0
        node = self._holding(node, n)
        before = self.up[node][0]
        return self._grown(self.mark[before], self.piece[node][: n - self.size[before]])

    def letters(self, node: int, above: int = 0) -> bytes:
        """The letters behind the ancestor ``above``."""
        out = []
        while node != above:
            out.append(self.piece[node])
            node = self.up[node][0]
        return b"".join(reversed(out))

    def shared(self, a: int, b: int) -> int:
        """The last node that two strings have in common."""
        if self.deep[a] < self.deep[b]:
            a, b = b, a
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.deep[self.up[a][k]] >= self.deep[b]:
                a = self.up[a][k]
        if a == b:
            return a
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.up[a][0]

    def less(self, a: int, b: int) -> bool:
        """Whether string a sorts before b, by the letter behind their longest common beginning. It is found by hashes, and the
        letters behind the last shared node are then compared, so that equal hashes of unequal letters do no harm."""
        low, high = self.size[root := self.shared(a, b)], min(self.size[a], self.size[b])
        while low < high:
            mid = (low + high + 1) // 2
            if self.hash(a, mid) == self.hash(b, mid):
                low = mid
            else:
                high = mid - 1
        x, y, n = self.letters(a, root), self.letters(b, root), low - self.size[root]
        if x[:n] != y[:n]:
            return x < y
        return x[n : n + 1] < y[n : n + 1]


class Table:
    """The cheapest (cost, node) of each state; of equal costs the least letters."""

    def __init__(self, trails: Trails):
        self.trails, self.best = trails, {}

    def offer(self, state: int, cost: int, node: int, piece: bytes) -> None:
        have = self.best.get(state)
        if have is None or cost < have[0]:
            self.best[state] = (cost, node, piece)
        elif cost == have[0]:
            mine = self.trails.add(node, piece) if piece else node
            if have[2]:
                have = self.best[state] = (cost, self.trails.add(have[1], have[2]), b"")
            if mine != have[1] and self.trails.less(mine, have[1]):
                self.best[state] = (cost, mine, b"")

    def settled(self, state: int) -> tuple[int, int]:
        cost, node, piece = self.best[state]
        if piece:
            node = self.trails.add(node, piece)
            self.best[state] = (cost, node, b"")
        return cost, node


def _insert(table: Table) -> None:
    """Rows may be inserted anywhere: cheapest states first, none twice."""
    done: set[int] = set()
    while len(done) < len(table.best):
        state = min((s for s in table.best if s not in done), key=lambda s: table.best[s][0])
        done.add(state)
        to = TURN[state][1]
        if to not in done:
            cost, node = table.settled(state)
            table.offer(to, cost + INSERT, node, b"I")


@lru_cache(maxsize=4096)
def edits(rows: str, start: int) -> tuple[tuple[int, int, bytes], ...]:
    """(end state, cost, audit) for rows given as one letter each: role initials, in upper case where the row is truncated, x for
    any other role, d for rows that must go."""
    trails = Trails()
    table = Table(trails)
    table.offer(start, 0, 0, b"")
    _insert(table)
    for row in rows:
        after = Table(trails)
        extra = CUT if row.isupper() else 0
        for state in sorted(table.best):
            cost, node = table.settled(state)
            after.offer(state, cost + DELETE, node, b"D")
            if row != "d":
                kept = NEXT[state].get(row.lower())
                if kept is not None:
                    after.offer(kept, cost + extra, node, b"K")
                after.offer(TURN[state][1], cost + REROLE + extra, node, b"R")
        table = after
        _insert(table)
    return tuple((s, cost, trails.letters(node)) for s in sorted(table.best) for cost, node in [table.settled(s)])


def joined(pieces: Iterator[dict[int, tuple]]) -> tuple[int, bytes]:
    """(cost, audit) of a conversation from its pieces in order, each with the ways from every state it may start in."""
    trails = Trails()
    table = Table(trails)
    table.offer(0, 0, 0, b"")
    for ways in pieces:
        after = Table(trails)
        for state in sorted(table.best):
            cost, node = table.settled(state)
            for end, more, audit in ways[state]:
                after.offer(end, cost + more, node, audit)
        table = after
    final = Table(trails)
    for state in ENDS:
        if state in table.best:
            cost, node = table.settled(state)
            final.offer(0, cost, node, b"")
    cost, node = final.settled(0)
    return cost, trails.letters(node)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of rows spoilt by crc32(conv:turn) % 20, nulls taken as one blank in every column: 0 drops a
    row, 1 empties its text, 2 takes out its . ! and ?, 3 repeats it, 4 makes its role user."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank(conv), blank(turn)).cast("binary")) % 20
    spoilt = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    named = F.when(fault == 4, F.lit("user")).otherwise(blank(role))
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), named.alias("role"), spoilt.alias("text"), F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"), fault.alias("fault"))
    return out.where("fault <> 0").drop("fault")


def _mark() -> Column:
    """A digest of role and text."""
    return F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)


def _judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, initial, blank, truncated, copies, late): equal rows of a turn once, with their number; ``late`` where an
    earlier turn has the same role and text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    each = rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", _mark().alias("mark"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "copies")
    once = each.groupBy("conv", "turn", "role", "mark", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = once.where("NOT blank").groupBy("conv", "mark").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1").select(F.col("conv").alias("c"), F.col("mark").alias("m"), "first")
    met = once.join(again, once["conv"].eqNullSafe(again["c"]) & (once["mark"] == again["m"]), "left").withColumn("late", F.coalesce(order > F.col("first"), F.lit(False)))
    return met.select("conv", "turn", "role", "mark", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "copies", "late")


WAYS = "array<struct<begin:int,end:int,cost:long,audit:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


class Piece:
    """Neighbouring rows of a conversation, as far as they have come."""

    def __init__(self, conv, starts: tuple[int, ...]):
        self.conv, self.starts, self.rows, self.counts = conv, starts, [], dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.head = self.tail = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, row: str, copies: int) -> None:
        """``copies`` equal rows of a turn: one letter each, as in edits."""
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.tail is None:
            self.head = initial
        else:
            self.counts["illegal"] += self.tail + initial not in ("su", "ua", "au")
        self.counts["illegal"] += copies - 1
        self.tail = initial
        self.rows.append(row * copies)

    def row(self, part: int, number: int) -> dict:
        ways = [{"begin": b, "end": e, "cost": c, "audit": a.decode()} for b in self.starts for e, c, a in edits("".join(self.rows), b)]
        return {"conv": self.conv, "part": part, "piece": number, "low": self.low, "high": self.high, "turns": self.turns, "head": self.head, "tail": self.tail, **self.counts, "ways": ways}


def _pieces(judged: DataFrame, kind: str) -> DataFrame:
    """Conversations in pieces of about PIECE_ROWS rows, numbered in order by (part, piece), each with the ways through it from the
    start or, where rows may come before it, from every state."""
    schema = f"conv {kind}, part int, piece int, low long, high long, turns long, head string, tail string, {', '.join(f'{c} long' for c in COUNTS)}, ways {WAYS}"
    n = partitions(judged.sparkSession)

    def run(batches):
        part, number, held, out = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or r["conv"] != held.conv:
                    starts = (0, 1, 2, 3) if held is None else (0,)  # a part may begin inside a conversation
                    if held is not None:
                        out.append(held.row(part, number))
                        number += 1
                    held = Piece(r["conv"], starts)
                left, first = r["copies"], True
                while left:
                    if len(held.rows) >= PIECE_ROWS:
                        out.append(held.row(part, number))
                        number += 1
                        held = Piece(r["conv"], (0, 1, 2, 3))
                    late = r["late"] or not first
                    if r["blank"] or late:
                        row, fault, copies = "d", "blank" if r["blank"] else "duplicate", min(left, PIECE_ROWS)
                    else:
                        row, fault, copies = r["initial"] if r["initial"] in ("s", "u", "a") else "x", "truncated" if r["truncated"] else None, 1
                        row = row.upper() if r["truncated"] else row
                    if fault:
                        held.counts[fault] += copies
                    held.add(r["turn"], r["initial"], row, copies)
                    left, first = left - copies, False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row(part, number)], schema=arrow)

    arrow = _arrow(judged.sparkSession, schema)
    return judged.repartitionByRange(n, *_order()).sortWithinPartitions(*_order()).mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _audits(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): the pieces of each conversation put together."""
    schema = f"conv {kind}, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"
    arrow = _arrow(pieces.sparkSession, schema)

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        out, now = [], next(rows, None)
        while now is not None:
            total, ends = dict.fromkeys((*COUNTS, "turns"), 0), {"low": None, "high": None, "tail": None}
            conv = now["conv"]

            def parts():
                nonlocal now
                while now is not None and now["conv"] == conv:
                    r = now
                    for c in total:
                        total[c] += r[c]
                    if ends["tail"] is not None:
                        total["illegal"] += ends["tail"] + r["head"] not in ("su", "ua", "au")
                    ends["tail"] = r["tail"]
                    if r["low"] is not None:
                        total["turns"] -= r["low"] == ends["high"]
                        ends["low"], ends["high"] = r["low"] if ends["low"] is None else ends["low"], r["high"]
                    ways: dict[int, list] = {}
                    for w in r["ways"]:
                        ways.setdefault(w["begin"], []).append((w["end"], w["cost"], w["audit"].encode()))
                    now = next(rows, None)
                    yield ways

            cost, audit = joined(parts())
            gaps = 0 if ends["low"] is None else ends["high"] - ends["low"] + 1 - total["turns"]
            out.append({"conv": conv, "gaps": gaps, **{c: total[c] for c in COUNTS}, "cost": cost, "audit": audit.decode()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    order = [F.col("conv").asc_nulls_first(), F.col("part"), F.col("piece")]
    return pieces.repartition(partitions(pieces.sparkSession), "conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def audits(spoilt: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations given as (conv, turn, role, text, copies).

    Rows are taken by turn, nulls first, then by role and by a digest of role and text. A row's first fault counts: blank, then
    duplicate (role and text seen earlier), then truncated (the last character that is not blank is none of . ! ?).
    ``gaps`` are the turns missing between the least and the greatest, ``illegal`` the neighbours whose role initials are not
    su, ua or au. ``audit`` are the cheapest edits that give role initials (s?(ua)+)?, least in ASCII among equals: K keeps a row, R makes it
    user or assistant (3), D deletes it (4; blank and duplicate rows must go), I inserts a row without text (3); a truncated row
    that stays costs 3 more. A role with another initial, an empty one too, cannot be kept. Conversations without rows have no result.

    Texts do not travel here, but their digests; equal rows of a turn are one row with a number from the first aggregation on. A
    conversation of any length is spread over tasks by turn, and only its pieces meet: their audits, one byte a row and state.
    """
    kind = dict(spoilt.dtypes)["conv"]
    return _audits(_pieces(_judged(spoilt), kind), kind)


def repaired(spoilt: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, in order within a partition. A task streams a
    conversation and holds its audit."""
    kind = dict(spoilt.dtypes)["conv"]
    schema = f"conv {kind}, place long, edit string, role string, text string"
    arrow = _arrow(spoilt.sparkSession, schema)
    head = audited.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("mark"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    rows = spoilt.select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", _mark().alias("mark"), "text", "copies")

    def run(batches):
        out: list[dict] = []
        state: dict = {}

        def write(letter: str, row: dict | None) -> None:
            if letter == "D":
                return
            if letter == "K":
                role, state["now"] = row["role"], NEXT[state["now"]][row["role"][:1]]
            else:
                initial, state["now"] = TURN[state["now"]]
                role = ROLES[initial]
            out.append({"conv": state["conv"], "place": state["place"], "edit": letter, "role": role, "text": row["text"] if row else ""})
            state["place"] += 1

        def inserted() -> None:
            while state and state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
                write("I", None)
                state["at"] += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    inserted()
                    state = {"conv": r["conv"], "audit": r["text"], "at": 0, "place": 0, "now": 0}
                    continue
                for _ in range(r["copies"]):
                    inserted()
                    write(state["audit"][state["at"]], r)
                    state["at"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        inserted()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    order = [F.col("conv").asc_nulls_first(), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    both = head.unionByName(rows).repartition(partitions(spoilt.sparkSession), "conv").sortWithinPartitions(*order)
    return both.select("conv", "kind", "role", "text", "copies").mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines role:text of each conversation, joined by line ends, from repaired."""
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            names, sums = [], []
            for c, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == 0:
                    if digest is not None:
                        names.append(conv)
                        sums.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged first (damage)
    and then repaired (audits, repaired, digests); zeros, an empty audit and the empty text's hash where no row is left.

    A null conversation is one of its own; null turns come first and make no gaps; a null role or text is one blank. Rows that repeat
    are duplicates. An empty table gives an empty result. Other columns are not read.
    """
    spoilt = damage(rows, conv, turn, role, text)
    audited = staged(audits(spoilt), "audits")
    sums = digests(repaired(spoilt, audited))
    every = rows.select(F.col(conv).alias("id")).distinct()
    found = every.join(audited, every["id"].eqNullSafe(audited["conv"]), "left").drop("conv")
    found = found.join(sums, found["id"].eqNullSafe(sums["conv"]), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select(F.col("id").alias(conv), *[number(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

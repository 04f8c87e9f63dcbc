"""Secret scans with a trigram inverted index, with DataFrame operations only.

Cox, "Regular Expression Matching with a Trigram Index" (2012). Every rule's pattern implies a Boolean query over trigrams, an OR of
sets of trigrams that each must all be in a text that matches. The index has a posting for each document and each of the trigrams that
some rule asks for. Postings are intersected per set, and a rule's pattern is run over the texts that pass. A rule whose
pattern has no trigram that every match holds is run over all texts.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import column, staged


class Rule(NamedTuple):
    kind: str
    pattern: str  # read alike by Java and by Python; matches are leftmost and do not overlap
    group: int = 0  # what must be ``least`` characters long for a match to count
    least: int = 1


#: The three kinds of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # as a run of any length and then at least 20 in all
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: The published forms of keys that stand out by themselves.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?:xoxa|xoxb|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[^\x00-\x20/:@]+@"),
)

Query = frozenset  # of sets of trigrams; the query {{}} holds for every text
ALL: Query = frozenset([frozenset()])
MOST = 64  # strings, or sets of trigrams, that a part of a pattern may stand for before it is taken as anything


def _both(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x in a for y in b)
    joined = frozenset(x for x in joined if not any(y < x for y in joined))
    return joined if len(joined) <= MOST else min(a, b, key=len)


def _either(queries: list[Query]) -> Query:
    found = frozenset().union(*queries)
    return ALL if frozenset() in found or len(found) > MOST else found


def _of_strings(strings: set[str]) -> Query:
    """What holds of every text with one of the strings."""
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _part(op, value) -> tuple[set[str] | None, Query]:
    """(the strings a part of a pattern stands for, or None for too many; what holds of a text in which it matches)."""
    if op is c.LITERAL:
        return {chr(value).lower()}, ALL
    if op is c.IN and all(o is c.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}, ALL
    if op is c.SUBPATTERN:
        return _sequence(value[3])
    if op is c.BRANCH:
        sides = [_sequence(s) for s in value[1]]
        strings = None if any(s is None for s, _ in sides) else set().union(*(s for s, _ in sides))
        return strings, _either([_both(q, _of_strings(s)) if s is not None else q for s, q in sides])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == 0:
            return None, ALL
        return None, _both(query, _of_strings(strings)) if strings is not None else query
    if op is c.AT:
        return {""}, ALL
    return None, ALL  # character ranges and whatever else: anything


def _sequence(parts) -> tuple[set[str] | None, Query]:
    """Parts in a row: strings grow while they are few, and their trigrams are asked for where they end."""
    run, query, whole = {""}, ALL, True
    for op, value in parts:
        strings, inner = _part(op, value)
        query = _both(query, inner)
        longer = {a + b for a in run for b in strings} if strings is not None else None
        if longer is not None and len(longer) <= MOST:
            run = longer
        else:
            query, run, whole = _both(query, _of_strings(run)), strings or {""}, False
            if strings is None:
                run = {""}
    return (run, query) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams in lower case, one of which every text with a match holds whole; {{}} if the pattern implies none."""
    strings, query = _sequence(parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def _queries(rules: tuple[Rule, ...]) -> dict[str, Query]:
    found = {r.kind: trigram_query(r.pattern) for r in rules}
    return {kind: q for kind, q in found.items() if frozenset() not in q}


def index(docs: DataFrame, trigrams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(trigram, id): a posting for each row and each of the given trigrams that its text holds, in lower case, by trigram and id."""
    low = F.lower(F.coalesce(column(text).cast("string"), F.lit("")))
    rows = docs.select(column(key).alias("id"), low.alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return rows.select(F.explode(held).alias("trigram"), "id").repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, kinds): for each document the rules whose query its trigrams satisfy: postings are intersected as bits, one for each
    trigram of a set, of which the first 62 are asked for."""
    sets = [(kind, n, (1 << len(need[:62])) - 1, t, 1 << bit) for kind, q in sorted(queries.items()) for n, need in enumerate(sorted(map(sorted, q))) for bit, t in enumerate(need[:62])]
    asked = postings.sparkSession.createDataFrame(sets, "kind string, clause int, need long, trigram string, bit long")
    # One row for each trigram of a rule: bounded by the rules.
    met = postings.join(F.broadcast(asked), "trigram").groupBy("id", "kind", "clause", "need").agg(F.bit_or("bit").alias("has"))
    return met.where("has = need").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(sizes: Column) -> Column:
    """For each of the sizes the sum of those before it, in steps of a square root, so that no long array is copied again and again."""
    none = F.array().cast("array<int>")

    def scanned(values: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), none.alias("sums"))
        grow = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["sums"], F.array(a["sum"])).alias("sums"))
        return F.aggregate(values, start, grow)["sums"]

    def blocks(s: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / step).cast("int")), lambda i: F.slice(s, i * step + 1, step))

    totals = lambda b: F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    return _let(sizes, lambda s: F.when(F.size(s) == 0, none).otherwise(_let(blocks(s), lambda b: F.flatten(F.zip_with(b, scanned(totals(b), F.lit(0)), scanned)))))


def spans(body: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule's matches, in code points, ends exclusive, of those that are long enough."""
    hits = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(body, rule.pattern, -1)
    parts = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))

    def placed(p: Column) -> Column:
        starts = F.zip_with(p, _sums(F.transform(p, lambda x: x["gap"] + x["hit"])), lambda x, s: F.struct((x["gap"] + s).alias("start"), x["hit"].alias("hit")))
        made = lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (x["start"] + x["hit"]).alias("end"))
        return F.array_compact(F.zip_with(starts, judged, lambda x, j: F.when(F.length(j) >= rule.least, made(x))))

    return _let(parts, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[str, ...] = tuple(r.kind for r in BASE), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_<kind> of each base kind, base_sha256, spans): the secrets of every whole text, one row per input row.

    A span is kind:start:end in code points, the end exclusive; spans are sorted by start, then in the order of the rules, and
    joined by commas. ``base_sha256`` is over the spans of the base kinds alone, ``spans`` holds all. A match whose group is
    shorter than its rule asks for does not count, and the next one is looked for behind it.

    Null texts count as empty and have no spans. Rows that repeat a key are each scanned by the rules that one of them is a
    candidate for; rows with a null key by all rules. An empty table gives an empty result. Other columns are not read.
    Rules without a mandatory trigram (here: hex) are run over every text.
    """
    queries = _queries(rules)
    wanted = sorted({t for q in queries.values() for need in q for t in need})
    postings = staged(index(docs.where(column(key).isNotNull()), wanted, text, key), "postings")
    found = candidates(postings, queries)
    rows = docs.select(column(key).alias("id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("body"))
    joined = rows.join(found, "id", "left")
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")

    def of(n: int, rule: Rule) -> Column:
        due = F.col("id").isNull() | F.array_contains("kinds", rule.kind) if rule.kind in queries else F.col("body").rlike(rule.pattern)
        return F.when(F.coalesce(due, F.lit(False)), spans(F.col("body"), rule, n)).otherwise(none)

    each = joined.select("id", *[of(n, r).alias(r.kind) for n, r in enumerate(rules)])
    line = lambda kinds: F.array_join(F.transform(F.array_sort(F.concat(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return each.select(F.col("id").alias(key), *counts, F.sha2(line(base), 256).alias("base_sha256"), line([r.kind for r in rules]).alias("spans"))

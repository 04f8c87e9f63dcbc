"""Term metrics over (corpus_id, doc_id, term, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed, ranked

MOST_CORPORA = 100_000


def substitute(terms: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Replace sub forms by their main form (C4)."""
    if groups is None:
        return terms
    return terms.join(groups, terms["term"] == groups["subform"], "left").withColumn("term", F.coalesce("mainform", "term")).drop("mainform", "subform")


def between(column: str, start, end, closed: bool = True) -> Column:
    """[start, end], or ]start, end] where not ``closed``."""
    c = F.col(column)
    return ((c >= F.lit(start)) if closed else (c > F.lit(start))) & (c <= F.lit(end))


def occurrences(terms: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """Sum of weights of each term."""
    return substitute(terms, groups).groupBy(*by, "term").agg(F.sum("weight").alias("occurrences"))


def tfidf_ranking(terms: DataFrame, scope: DataFrame, groups: DataFrame | None = None, nd: str = "docs") -> DataFrame:
    """(term, tf, nd, score) with score = tf (ln M - ln nd) over ``scope``, for the terms of ``terms``.

    ``nd`` counts documents, or index rows with "rows", where it may pass M once groups merge rows.
    """
    if nd not in ("docs", "rows"):
        raise ValueError("nd is docs or rows")
    total = scope.agg(F.countDistinct("doc_id").alias("M"))
    count = F.countDistinct("doc_id") if nd == "docs" else F.count("*")
    found = substitute(scope, groups).groupBy("term").agg(F.sum("weight").alias("tf"), count.alias("nd"))
    if terms is scope:
        wanted = found.where("term is not null")
    else:
        wanted = found.join(substitute(terms, groups).select("term").distinct(), "term", "left_semi")
    scored = wanted.crossJoin(F.broadcast(total))
    return scored.select("term", "tf", "nd", (F.col("tf") * (F.ln("M") - F.ln("nd"))).alias("score"))


def tfidf_documents(terms: DataFrame, members: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(corpus_id, doc_id, term, score): tf-idf of each term in each document of its corpus (D3). Rows are dealt by corpus and term
    once, and summed and counted there; the corpora's sizes go to every task where they are at most MOST_CORPORA."""
    sizes = checkpointed(terms.groupBy("corpus_id").agg(F.countDistinct("doc_id").alias("N")))
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_CORPORA else sizes
    forms = substitute(terms, groups)
    if members is not None:
        forms = forms.join(members, "term", "left_semi")
    rows = forms.select("corpus_id", "doc_id", "term", "weight").repartition("corpus_id", "term")
    tf = rows.groupBy("corpus_id", "doc_id", "term").agg(F.sum("weight").alias("tf"))
    found = tf.withColumn("nd", F.count("*").over(Window.partitionBy("corpus_id", "term")))
    return found.join(sizes, "corpus_id").select("corpus_id", "doc_id", "term", (F.col("tf") * (F.ln("N") - F.ln("nd"))).alias("score"))


def document_frequency(terms: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Documents with a positive weight, by corpus and term."""
    rows = terms if members is None else terms.join(members, "term", "left_semi")
    return rows.where("weight > 0").groupBy("corpus_id", "term").agg(F.countDistinct("doc_id").alias("df"))


def representativity(terms: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Document frequency over the corpus's number of documents."""
    sizes = terms.groupBy("corpus_id").agg(F.countDistinct("doc_id").alias("N"))
    return document_frequency(terms, members).join(sizes, "corpus_id").select("corpus_id", "term", F.try_divide("df", "N").alias("representativity"))


def compare_corpora(terms: DataFrame, a: str, b: str, members: DataFrame | None = None) -> DataFrame:
    """(term, ratio): representativity in b over that in a for the terms of a; absent from b: the smallest ratio.
    The document frequency where a is b (D6)."""
    if a == b:
        return document_frequency(terms.where(F.col("corpus_id") == a), members).select("term", F.col("df").cast("double").alias("ratio"))
    both = representativity(terms.where(F.col("corpus_id").isin(a, b)), members)
    sides = both.groupBy("term").agg(F.max(F.when(F.col("corpus_id") == a, F.col("representativity"))).alias("ra"), F.max(F.when(F.col("corpus_id") == b, F.col("representativity"))).alias("rb")).where("ra is not null")
    ratio = sides.withColumn("ratio", F.try_divide("rb", "ra"))
    least = ratio.agg(F.min("ratio").alias("least"))
    return ratio.crossJoin(F.broadcast(least)).select("term", F.coalesce("ratio", "least").alias("ratio"))


def growth(terms: DataFrame, members: DataFrame, start: str, end: str, date: str = "pub_date") -> DataFrame:
    """(term, growth): 100 (s2 - s1) / (s2 + s1) of the occurrences in ]start - span, start] and ]start, end]; 0 where
    either is missing (D7)."""
    first = F.date_sub(F.lit(start).cast("date"), F.datediff(F.lit(end), F.lit(start)))
    start_, end_ = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = F.col(date)
    rows = terms.join(members, "term", "left_semi").where((d > first) & (d <= end_))
    sums = rows.groupBy("term").agg(F.sum(F.when(d <= start_, F.col("weight"))).alias("s1"), F.sum(F.when(d > start_, F.col("weight"))).alias("s2"))
    value = F.round(F.try_divide(100 * (F.col("s2") - F.col("s1")), F.col("s2") + F.col("s1")), 2)
    return members.select("term").distinct().join(sums, "term", "left").select("term", F.coalesce(value, F.lit(0.0)).alias("growth"))


def facet(docs: DataFrame, column: str) -> DataFrame:
    """(value, n_docs) with the missing as _NA_ and a total as _ALL_."""
    value = docs.select(F.coalesce(F.col(column).cast("string"), F.lit("_NA_")).alias("value"))
    return value.rollup("value").agg(F.count("*").alias("n_docs")).select(F.coalesce("value", F.lit("_ALL_")).alias("value"), "n_docs")


UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def bucket(c: Column, unit: str) -> Column:
    """Start of the time bucket; decades start in years ending in 0, centuries in 1."""
    if unit == "decade":
        return F.make_date((F.floor(F.year(c) / 10) * 10).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    if unit == "century":
        return F.make_date((F.floor((F.year(c) - 1) / 100) * 100 + 1).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    if unit not in UNITS:
        raise ValueError(f"no time unit {unit!r}")
    return F.date_trunc(unit, c)


def history(rows: DataFrame, time: str, unit: str, measure: str = "weight", fill: bool = False, divide_by: DataFrame | None = None) -> DataFrame:
    """(bucket, value): sum of weights, or distinct documents, in each time bucket.

    Rows without a time are left out. ``fill`` adds empty buckets (up to years) between the first and the last;
    ``divide_by`` holds the rows whose measure each value is divided by.
    """
    if measure not in ("weight", "documents"):
        raise ValueError("measure is weight or documents")
    value = F.sum("weight") if measure == "weight" else F.countDistinct("doc_id").cast("double")
    count = lambda df: df.where(F.col(time).isNotNull()).groupBy(bucket(F.col(time), unit).alias("bucket")).agg(value.alias("value"))
    out = count(rows)
    if divide_by is not None:
        out = out.join(count(divide_by).withColumnRenamed("value", "whole"), "bucket").select("bucket", F.try_divide("value", "whole").alias("value"))
    if fill:
        steps = {"week": "7 day", "quarter": "3 month", "decade": "10 year", "century": "100 year"}.get(unit, f"1 {unit}")
        ends = out.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
        grid = ends.select(F.explode(F.expr(f"sequence(a, b, interval {steps})")).alias("bucket"))
        out = grid.join(out, "bucket", "left").select("bucket", F.coalesce("value", F.lit(0.0)).alias("value"))
    return out


def search_terms(terms: DataFrame, prefix: str = "", inside: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    """(term, weight, total): terms by falling weight, then by name, one page of them, with the number of all."""
    found = terms.where(F.col("term").startswith(prefix) & F.col("term").contains(inside)).groupBy("term").agg(F.sum("weight").alias("weight"))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("weight"), "term").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def occurrence_distribution(terms: DataFrame) -> DataFrame:
    """(corpus_id, occurrences, n_terms)."""
    return occurrences(terms).groupBy("corpus_id", "occurrences").agg(F.count("*").alias("n_terms"))


def child_counts(docs: DataFrame) -> DataFrame:
    """(project, corpus_id, n_docs) with a row of totals for each project."""
    counts = docs.rollup("project", "corpus_id").agg(F.count("*").alias("n_docs")).where("project is not null")
    return counts.select("project", F.coalesce("corpus_id", F.lit("_ALL_")).alias("corpus_id"), "n_docs")


def period_tfidf(terms: DataFrame, members: DataFrame, period: str) -> DataFrame:
    """(period, term, score): tf in the period times ln(all documents / documents of the period with the term)."""
    total = terms.agg(F.countDistinct("doc_id").alias("N"))
    found = terms.join(members, "term", "left_semi").groupBy(F.col(period).alias("period"), "term").agg(F.sum("weight").alias("tf"), F.countDistinct("doc_id").alias("nd"))
    return found.crossJoin(F.broadcast(total)).select("period", "term", (F.col("tf") * F.ln(F.col("N") / F.col("nd"))).alias("score"))


def period_distance(scores: DataFrame) -> DataFrame:
    """(p, q, distance): one minus the cosine of two periods' term vectors, p < q."""
    norms = scores.groupBy("period").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    a = scores.select("term", F.col("period").alias("p"), F.col("score").alias("x"))
    b = scores.select("term", F.col("period").alias("q"), F.col("score").alias("y"))
    dots = a.join(b, "term").where("p < q").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    left, right = (norms.select(F.col("period").alias(c), F.col("norm").alias(f"norm_{c}")) for c in "pq")
    every = F.broadcast(left).crossJoin(F.broadcast(right)).where("p < q")
    return every.join(dots, ["p", "q"], "left").select("p", "q", (1 - F.coalesce(F.try_divide(F.col("dot"), F.col("norm_p") * F.col("norm_q")), F.lit(0.0))).alias("distance"))


def relative_frequency(words: DataFrame, stop: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(term, frequency, n, total): words that start with no digit and are no stop words."""
    n = words.where(~F.col("term").rlike(r"^\d") & ~F.col("term").isin(*stop)).groupBy(*by, "term").agg(F.sum("weight").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = n.join(total, list(by)) if by else n.crossJoin(F.broadcast(total))
    return joined.select(*by, "term", F.try_divide("n", "total").alias("frequency"), "n", "total")


def top_part(frequencies: DataFrame, percent: float) -> DataFrame:
    """The top percent of the terms by frequency, ties by term."""
    most = frequencies.agg(F.bround(F.count("*") * percent / 100).cast("long").alias("most"))
    placed = ranked(frequencies, F.desc("frequency"), F.col("term"))
    return placed.crossJoin(F.broadcast(most)).where("rank < most").drop("rank", "most")


def top_part_by(frequencies: DataFrame, percent: float, by: str) -> DataFrame:
    """The top percent of the terms of each value of ``by``, by frequency, ties by term (E8's first step)."""
    most = frequencies.groupBy(by).agg(F.bround(F.count("*") * percent / 100).cast("long").alias("most"))
    first = frequencies.groupBy(by).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a slice
    starts = first.select(by, before.alias("start")).join(most, by)
    placed = ranked(frequencies, F.col(by), F.desc("frequency"), F.col("term"))
    return placed.join(starts, by).where("rank - start < most").drop("rank", "start", "most")


def specificities(frequencies: DataFrame, reference: DataFrame, percent: float) -> DataFrame:
    """Top terms that are no top terms of the reference."""
    return top_part(frequencies, percent).join(top_part(reference, percent).select("term"), "term", "left_anti")


def historic_specificity(frequencies: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, term, specificity): frequency minus its mean over all slices, 0 where absent."""
    n = slices.agg(F.count("*").alias("slices"))
    mean = frequencies.groupBy("term").agg(F.sum("frequency").alias("sum")).crossJoin(F.broadcast(n)).select("term", (F.col("sum") / F.col("slices")).alias("mean"))
    grid = mean.crossJoin(F.broadcast(slices))
    return grid.join(frequencies.select("slice", "term", "frequency"), ["slice", "term"], "left").select("slice", "term", (F.coalesce("frequency", F.lit(0.0)) - F.col("mean")).alias("specificity"))


def homogeneity(terms: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, homogeneity, new_terms, vocabulary): tokens times documents over distinct terms of each slice, and the
    growth of the vocabulary (D20). ``slices`` is (doc_id, slice)."""
    rows = terms.join(slices, "doc_id")
    each = rows.groupBy("slice").agg(F.sum("weight").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("term").alias("distinct_terms"))
    fresh = rows.groupBy("term").agg(F.min("slice").alias("slice")).groupBy("slice").agg(F.count("*").alias("new_terms"))
    joined = each.join(fresh, "slice", "left").withColumn("new_terms", F.coalesce("new_terms", F.lit(0)))
    running = F.sum("new_terms").over(Window.orderBy("slice"))  # one row a slice
    return joined.select("slice", F.try_divide(F.col("tokens") * F.col("docs"), "distinct_terms").alias("homogeneity"), "new_terms", running.alias("vocabulary"))


def catalogue(metadata: DataFrame, most: int = 48) -> DataFrame:
    """(key, kind, n, least, greatest, known) of (doc_id, key, kind, value); the values where there are at most ``most``."""
    distinct = metadata.groupBy("key", "kind", "value").agg(F.count("*").alias("n"))
    found = distinct.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("many"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    few = distinct.join(F.broadcast(found.where(F.col("many") <= most).select("key", "kind")), ["key", "kind"], "left_semi").groupBy("key", "kind").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("known"))
    return found.join(few, ["key", "kind"], "left").select("key", "kind", "n", "least", "greatest", "known")

"""Operators over documents and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T

from .storage import ranked


def phrases(docs: DataFrame, text: Column, stop: DataFrame, most: int = 6, keys: tuple[str, ...] = ("corpus_id", "doc_id")) -> DataFrame:
    """(*keys, term): runs of words between stop words and punctuation, of at most ``most`` words."""
    return _with_stops(docs, text, stop).select(*keys, F.explode(T.phrases_between(F.col("_tokens"), F.col("_stops"), most)).alias("term"))


MOST_STOPS = 100_000


def _with_stops(docs: DataFrame, text: Column, stop: DataFrame) -> DataFrame:
    """The documents with their words and signs, and the stop words as one array, which goes to every task: more than MOST_STOPS
    are an error."""
    stops = stop.select("term").distinct().limit(MOST_STOPS + 1).agg(F.collect_list("term").alias("_stops"))
    checked = F.when(F.size("_stops") <= MOST_STOPS, F.col("_stops")).otherwise(F.raise_error(F.lit(f"more than {MOST_STOPS} stop words")).cast("array<string>"))
    found = F.regexp_extract_all(F.lower(text), F.lit(T.TOKEN + r"|[^\s]"), F.lit(0))
    return docs.withColumn("_tokens", found).crossJoin(F.broadcast(stops.select(checked.alias("_stops"))))


def document_terms(docs: DataFrame, text: Column, stop: DataFrame, lang: Column | None = None, supported: tuple[str, ...] = (), most: int = 6, keys: tuple[str, ...] = ("corpus_id", "doc_id")) -> DataFrame:
    """(*keys, term, weight) of each document's phrases (B6), normalised, of two characters and more, cut at 255, counted.

    With ``lang``, documents in none of the ``supported`` languages are skipped. A document's words are cut, put in order and counted within
    its row, and never shuffled.
    """
    rows = docs if lang is None else docs.where(lang.isin(*supported))
    terms = F.transform(T.phrases_between(F.col("_tokens"), F.col("_stops"), most), lambda t: F.substring(T.normalise_term(t), 1, 255))
    counts = _with_stops(rows, text, stop).select(*keys, F.explode(T.counted(F.filter(terms, lambda t: F.length(t) > 1))).alias("t"))
    return counts.select(*keys, "t.term", "t.weight")


def weigh_terms(candidates: DataFrame, keys: tuple[str, ...] = ("corpus_id", "doc_id")) -> DataFrame:
    """(*keys, term, weight): normalised candidates of two characters and more, cut at 255, counted."""
    terms = candidates.select(*keys, F.substring(T.normalise_term(F.col("term")), 1, 255).alias("term")).where(F.length("term") > 1)
    return terms.groupBy(*keys, "term").agg(F.count("*").cast("double").alias("weight"))


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, n) of the distinct terms with their number of words."""
    return terms.select("term").distinct().select("term", (F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1).alias("n"))


def metadata_index(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(doc_id, key, kind, value): one row per field with a value, typed by its column; texts are cut at 2712 characters."""
    kinds = dict(docs.dtypes)
    long = F.array(*[F.struct(F.lit(f).alias("key"), F.lit(kinds[f]).alias("type"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(long).alias("m")).select("doc_id", "m.*").where("value is not null")
    size = F.length("value")
    kind = F.when(F.col("type").isin("int", "bigint", "smallint", "tinyint"), "int").when(F.col("type").isin("float", "double"), "flt").when(F.col("type").isin("timestamp", "date"), "utc").when(size < 255, "str").otherwise("txt")
    return rows.select("doc_id", "key", kind.alias("kind"), F.substring("value", 1, 2712).alias("value"))


def index_terms(docs: DataFrame, text: Column, new: DataFrame, known: DataFrame | None = None, longest: int = 6) -> DataFrame:
    """(doc_id, term, weight) of new terms of up to ``longest`` words in the texts, without the rows already known.

    All terms are looked for at once. Runs of words start only where a word is the first of a term, and have only lengths that a term has; they
    are counted within the row, and meet the terms in one hash join. The first words go to every task as one array, up to MOST_STARTS,
    counted first; beyond, every run of words meets the terms.
    """
    words = T.tokens(F.lower(text))
    wanted = new.select("term").distinct()
    split = F.split("term", " ")
    starts = wanted.where(F.size(split) <= longest).select(split[0].alias("first"), F.size(split).alias("n"))
    if starts.select("first").distinct().limit(MOST_STARTS + 1).count() <= MOST_STARTS:
        every = starts.agg(F.collect_set("first").alias("_firsts"), F.sort_array(F.collect_set("n")).alias("_sizes"))  # one row
        rows = docs.select("doc_id", words.alias("_w")).crossJoin(F.broadcast(every))
        at = lambda w: T.let(F.array_intersect(w, F.col("_firsts")), lambda here: F.array_compact(F.transform(w, lambda t, i: F.when(F.array_contains(here, t), i))))
        run = lambda i: F.transform(F.filter("_sizes", lambda n: i + n <= F.size("_w")), lambda n: F.array_join(F.slice("_w", i + 1, n), " "))
        counts = rows.select("doc_id", F.explode(T.counted(F.flatten(F.transform(at(F.col("_w")), run)))).alias("t")).select("doc_id", "t.term", "t.weight")
        found = counts.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))
    else:
        found = _every_run(docs, words, wanted, longest)
    return found if known is None else found.join(known, ["doc_id", "term"], "left_anti")


MOST_STARTS = 100_000


def _every_run(docs: DataFrame, words: Column, wanted: DataFrame, longest: int) -> DataFrame:
    sizes = F.array(*[F.lit(n) for n in range(1, longest + 1)])
    runs = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", "w", F.explode(sizes).alias("n")).where(F.size("w") >= F.col("n"))
    runs = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("term"))
    return runs.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("weight"))


def document_sizes(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(key, words, distinct_words)."""
    words = T.tokens(F.lower(text))
    return docs.select(key, F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct_words"))


def paragraphs_in(docs: DataFrame, text: Column, wanted: Column, profile: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kept, kept_n, cut): the paragraphs whose stop words are mostly of the wanted language, and how many they are.

    ``profile`` is (lang, word), at most MOST_STOPS rows, which go to every task. A paragraph without any of its words stays; ties go to
    the smallest language. The words are looked up within the document's row, and texts are shuffled once; rows that share a key are
    judged together, paragraph by paragraph, and those without a key keep all.
    """
    rows = profile.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", "word").limit(MOST_STOPS + 1).agg(F.collect_list(F.struct("lang", "word")).alias("_profile"))
    checked = F.when(F.size("_profile") <= MOST_STOPS, F.col("_profile")).otherwise(F.raise_error(F.lit(f"more than {MOST_STOPS} profile words")).cast("array<struct<lang:string,word:string>>"))
    speaks = lambda w: F.transform(F.filter("_profile", lambda p: p["word"] == w), lambda p: p["lang"])
    here = lambda words: F.array_intersect(words, F.col("_profile")["word"])
    langs = lambda words: T.let(here(words), lambda known: F.flatten(F.transform(F.filter(words, lambda w: F.array_contains(known, w)), speaks)))
    judged = F.transform(F.split(text, r"\n[ \t\n\f\r]*\n|\n"), lambda p: F.struct(p.alias("part"), T.let(T.tokens(F.lower(p)), langs).alias("langs")))
    parts = docs.where(text.isNotNull()).crossJoin(F.broadcast(rows.select(checked.alias("_profile")))).select(key, F.struct(wanted.alias("wanted"), judged.alias("parts")).alias("row"))
    grouped = parts.repartition(key).groupBy(key).agg(F.collect_list("row").alias("rows"))
    places = F.sequence(F.lit(0), F.array_max(F.transform("rows", lambda r: F.size(r["parts"]))) - 1)
    at = lambda i: F.transform(F.filter("rows", lambda r: F.size(r["parts"]) > i), lambda r: F.struct(r["parts"][i]["part"].alias("part"), r["parts"][i]["langs"].alias("langs"), r["wanted"].alias("wanted")))
    best = lambda found: F.array_min(F.transform(T.counted(found), lambda c: F.struct((-c["weight"]).alias("n"), c["term"].alias("lang"))))["lang"]
    found = lambda here_: F.when(F.col(key).isNotNull(), best(F.flatten(here_["langs"])))
    keep = lambda here_: T.let(F.struct(found(here_).alias("found")), lambda f: F.transform(here_, lambda x: F.when(F.coalesce(f["found"] == x["wanted"], F.lit(True)), x["part"])))
    each = grouped.select(key, F.flatten(F.transform(places, lambda i: F.array_sort(T.let(at(i), keep)))).alias("parts"))
    stay = each.select(key, F.array_compact("parts").alias("stay"), F.size("parts").alias("n"))
    return stay.select(key, F.array_join("stay", "\n").alias("kept"), F.size("stay").alias("kept_n"), (F.size("stay") < F.col("n")).alias("cut"))


def language_profile(docs: DataFrame, lang: Column, supported: tuple[str, ...], by: str = "corpus_id") -> DataFrame:
    """(by, main_lang, n_docs, unsupported): most frequent supported language, __unknown__ without one."""
    counts = docs.select(by, lang.alias("lang")).groupBy(by, "lang").agg(F.count("*").alias("n"))
    good = F.col("lang").isin(*supported)
    best = F.min(F.when(good, F.struct((-F.col("n")).alias("n"), "lang")))
    bad = F.array_join(F.array_sort(F.collect_set(F.when(~good, F.col("lang")))), "|")
    return counts.groupBy(by).agg(F.coalesce(best["lang"], F.lit("__unknown__")).alias("main_lang"), F.sum("n").alias("n_docs"), bad.alias("unsupported"))


def sample_by_year(docs: DataFrame, year: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, year): for each year round(limit * k / N) documents, at least one, the smallest hashes first (A14). Ranks within the
    years come from one range partitioning by (year, hash), so that no task holds a year. Documents without a year are left out."""
    rows = docs.select(key, year.alias("year")).where("year IS NOT NULL")
    sizes = rows.groupBy("year").agg(F.count("*").alias("k"))  # one row a year
    before = F.coalesce(F.sum("k").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.greatest(F.lit(1), F.bround(limit * F.col("k") / F.sum("k").over(Window.partitionBy())))
    drawn = ranked(rows, F.col("year"), F.crc32(F.col(key).cast("string").cast("binary")), F.col(key))
    return drawn.join(sizes.select("year", before.alias("start"), quota.alias("quota")), "year").where("rank - start < quota").select(key, "year")

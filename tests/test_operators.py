"""Worked examples and invariants of the analytics operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import graph as G
from termloom.operators import lists as L
from termloom.operators import metrics as M
from termloom.sources import ingest as I
from termloom.streaming import incremental as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_specificity_example(spark):
    # A published worked example, counts of seven sentences' nouns, and its results.
    names = "animals food grass humans report rivers war water".split()
    grid = [[4, 2, 1, 1, 4, 0, 0, 1], [2, 3, 1, 1, 3, 0, 0, 1], [1, 1, 1, 0, 1, 0, 0, 0], [1, 1, 0, 3, 3, 0, 1, 1], [4, 3, 1, 3, 7, 1, 1, 3], [0, 0, 0, 0, 1, 1, 0, 1], [0, 0, 0, 1, 1, 0, 1, 0], [1, 1, 0, 1, 3, 1, 0, 3]]
    pairs = spark.createDataFrame([(a, b, grid[i][j]) for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2) if i <= j and grid[i][j]], "a string, b string, weight long")
    got = {r[0]: r[1:] for r in map(tuple, G.specificity(pairs).collect())}
    assert got["report"] == (8.0, 3.286, -4.714, 11.286)
    assert got["grass"] == (1.726, 4.0, 2.274, 5.726)
    assert got["war"] == got["rivers"] == (1.476, 3.0, 1.524, 4.476)


def test_algebra_examples(spark):
    wm = spark.createDataFrame([("1", "2", 0.5), ("1", "3", 0.75), ("2", "3", 0.6), ("3", "3", 1.0)], "a string, b string, weight double")
    ul = spark.createDataFrame([(str(i),) for i in range(1, 6)], "term string")
    wl = spark.createDataFrame([("1", 0.7), ("2", 0.8), ("7", 1.1)], "term string, weight double")
    t = spark.createDataFrame([("2", "3"), ("5", "4")], "mainform string, subform string")
    assert rows(L.matrix_plus(wm, wm)) == [("1", "2", 1.0), ("1", "3", 1.5), ("2", "3", 1.2), ("3", "3", 2.0)]
    assert rows(L.matrix_plus(wm, wm, -1)) == [] and rows(L.matrix_without(wm, ul)) == []
    assert rows(L.matrix_without(wm, wl)) == [("3", "3", 1.0)] and rows(L.matrix_inside(wm, wl)) == [("1", "2", 0.5)]
    assert rows(L.matrix_translate(wm, t)) == [("1", "2", 1.25), ("2", "2", 0.6), ("3", "2", 1.0)]
    assert rows(L.plus(ul, wl)) == [("1", 1.7), ("2", 1.8), ("3", 1.0), ("4", 1.0), ("5", 1.0), ("7", 1.1)]
    assert rows(L.difference(ul, wl)) == [("3",), ("4",), ("5",)] and rows(L.minus(wl, wl)) == []
    assert rows(L.translate(ul, t)) == [("1",), ("2",), ("5",)] and rows(L.compose(t, t)) == rows(t)


def test_group_union_example(spark):
    make = lambda *p: spark.createDataFrame(list(p), "mainform string, subform string")
    got = rows(L.group_union(make(("A", "B"), ("D", "E"), ("G", "H")), make(("A", "C"), ("E", "F"), ("G", "I"), ("H", "J"))))
    assert got == [("A", "B"), ("A", "C"), ("D", "E"), ("D", "F"), ("G", "H"), ("G", "I"), ("G", "J")]


def test_communities_separate_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0)]
    df = spark.createDataFrame(edges, "s string, t string, w double")
    got = dict(map(tuple, G.communities(df).collect()))
    assert len(got) == 10 and len({got[f"a{i}"] for i in range(5)}) == len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert dict(map(tuple, G.communities(df.repartition(3)).collect())) == got


def test_growth_window(spark):
    terms = spark.createDataFrame([("x", "1999-06-01", 3.0), ("x", "2000-06-01", 5.0), ("y", "2000-06-01", 5.0), ("x", "1998-12-31", 9.0)], "term string, d string, weight double").withColumn("pub_date", F.to_date("d"))
    assert rows(M.growth(terms, terms.select("term"), "2000-01-01", "2001-01-01")) == [("x", 25.0), ("y", 0.0)]


def test_text_functions(spark):
    assert one(spark, T.normalise_term(F.lit("'ecosystem services'"))) == "ecosystem services"
    assert one(spark, T.normalise_chars(F.lit("a\tb  c « d » œuf € …"))) == 'a b c "d" oeuf EUR ...'
    assert one(spark, F.size(T.sub_phrases(F.array(*map(F.lit, "Aa Bb Cc Dd".split()))))) == 10
    tagged = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(t).alias("tag")) for w, t in (("big", "J"), ("cat", "N"), ("eats", "V"), ("fish", "N"), ("raw", "J"))])
    assert one(spark, T.chunk_tagged(tagged, lambda t: t)) == ["big cat", "fish raw"]
    assert one(spark, T.count_term(F.lit("British. un-british british"), "british")) == 3
    assert one(spark, T.stem_key(F.lit("water supplies"))) == "water supply"


def test_dates(spark):
    assert one(spark, I.clean_date(F.lit("SPR"), F.lit("1994"))) == "1994"
    assert one(spark, I.clean_date(F.lit("NOV-DEC"), F.lit("1994"))) == "1994 NOV"
    assert one(spark, I.clean_date(F.lit("MAY 3-5"), F.lit("2001"))) == "2001 MAY 3"
    stamp = F.lit("2017-05-06").cast("timestamp")
    assert str(one(spark, M.bucket(stamp, "decade")))[:10] == "2010-01-01" and str(one(spark, M.bucket(stamp, "century")))[:10] == "2001-01-01"


def test_tagged_records(spark, tmp_path):
    body = "TY  - JOUR\nTI  - Two\nT1  - One\nAU  - A\nAU  - B\nAB  - first\n\nsecond\nER  - \nTY  - JOUR\nTI  - Three\nLA  - fr\n"
    (tmp_path / "x.ris").write_text(body)
    got = I.read_tagged(spark, str(tmp_path / "x.ris")).orderBy("record").collect()
    assert [(r.title, r.authors, r.abstract, r.lang) for r in got] == [("One", "A\nB", "first second", "en"), ("Three", None, None, "fr")]


def test_list_import_forms(spark):
    make = lambda cols, *r: spark.createDataFrame(list(r), ", ".join(f"{c} string" for c in cols))
    a = make(["status", "label", "forms"], ("map", "water table", "water tables"), ("map", "water supply", "water-supply|&|water supplies"), ("stop", "wastewater", ""), ("odd", "x", ""), ("map", "", "y"))
    lists, groups = I.import_lists(a, T.normalise_term)
    five = {"water table", "water tables", "water supply", "water-supply", "water supplies"}
    assert {r.term for r in lists.collect() if r.list_name == "map"} == five == {r.term for r in lists.collect() if r.list_name == "main"}
    assert rows(groups) == [("water supply", "water supplies"), ("water supply", "water-supply"), ("water table", "water tables")]
    with pytest.raises(ValueError):
        I.import_lists(make(["name"], ("x",)), T.normalise_term)


def test_cooccurrence_properties(spark):
    r = random.Random(3)
    data = [("c", d, f"t{r.randrange(8)}", 1.0) for d in range(30) for _ in range(5)]
    terms = spark.createDataFrame(data, "corpus_id string, doc_id long, term string, weight double")
    got = {(a, b): n for _, a, b, n in map(tuple, G.cooccurrences(terms, threshold=1, half=False).collect())}
    df = {t: n for _, t, n in map(tuple, M.document_frequency(terms).collect())}
    assert all(got[a, b] == got[b, a] for a, b in got) and all(got[t, t] == df[t] for t in df)


def test_index_stream_adds_once(spark, tmp_path):
    extract = lambda b: b.select("doc_id", F.explode(F.split("text", " ")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("weight"))
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for part in ([(1, "a b a")], [(2, "b c")], [(1, "a b a"), (3, "c")]):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(source)
        S.index_stream(spark.readStream.schema("doc_id long, text string").parquet(source), extract, out, log).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, "a", 2.0), (1, "b", 1.0), (2, "b", 1.0), (2, "c", 1.0), (3, "c", 1.0)]

"""Pruned pairs, counting within rows, searches of an index, many terms at once, groups by language, recounts by difference."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import documents as D
from termloom.operators import graph as G
from termloom.operators import lists as L
from termloom.operators import search as S
from termloom.plans import corpora, workflow
from termloom.streaming import incremental


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(r, n):
    return " ".join(r.choice(["the", "of", "water", "state-of", "Über", "deep", "sea", "x", "idiot", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, words(r, r.randint(0, 40)), r.choice(["en", "fr", "de", "es"])) for i in range(150)] + [(500, None, None), (501, "", "en"), (502, words(r, 6000), "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).persist()


def tokens(text):
    return re.findall(r"\w+(?:-\w+)*", (text or "").lower())


@pytest.mark.parametrize("cell", [2, 1024])
@pytest.mark.parametrize("half, diagonal", [(True, True), (True, False), (False, True), (False, False)])
def test_pairs_of_heavy_documents(spark, monkeypatch, cell, half, diagonal):
    monkeypatch.setattr(G, "CELL", cell)
    r = random.Random(4)
    sets = {d: {f"t{r.randrange(14)}" for _ in range(r.randint(0, 12))} for d in range(40)}
    terms = spark.createDataFrame([("c", d, t, 1.0) for d, s in sets.items() for t in s], "corpus_id string, doc_id long, term string, weight double")
    got = {(x.a, x.b): x.weight for x in G.cooccurrences(terms, threshold=3, half=half, diagonal=diagonal).collect()}
    count = collections.Counter((a, b) for s in sets.values() for a in s for b in s if (a <= b or not half) and (a != b or diagonal))
    assert got == {p: n for p, n in count.items() if n >= 3}


def test_the_threshold_prunes_terms_before_the_self_join(spark):
    terms = spark.createDataFrame([("c", 1, "a", 1.0)], "corpus_id string, doc_id long, term string, weight double")
    first = lambda threshold: G.cooccurrences(terms, threshold=threshold)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in first(3) and "LeftSemi" not in first(1)


def test_words_are_counted_within_the_row(spark, docs):
    got = docs.select("doc_id", F.explode(T.counted(T.tokens(F.lower("text")))).alias("t")).select("doc_id", "t.*")
    want = {(r.doc_id, w): n for r in docs.collect() for w, n in collections.Counter(tokens(r.text)).items()}
    assert {(r.doc_id, r.term): r.weight for r in got.collect()} == want
    assert "Exchange" not in plan(corpora.text_terms(spark, "/root/testdata/sf0.001"))


def test_phrases_and_terms_of_supported_languages(spark, docs):
    stop = spark.createDataFrame([("the",), ("of",)], "term string")
    want = collections.Counter()
    for r in docs.collect():
        run = []
        for t in [*re.findall(r"\w+(?:-\w+)*|[^\s]", (r.text or "").lower()), "."]:
            if t in ("the", "of") or not re.match(r"\w", t):
                if 0 < len(run) <= 6:
                    want[r.doc_id, " ".join(run)] += 1
                run = []
            else:
                run.append(t)
    got = collections.Counter((r.doc_id, r.term) for r in D.phrases(docs, F.col("text"), stop, keys=("doc_id",)).collect())
    assert got == want
    terms = D.document_terms(docs, F.col("text"), stop, F.col("lang"), ("en", "de"), keys=("doc_id",))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert {(r.doc_id, r.term): r.weight for r in terms.collect()} == {k: n for k, n in want.items() if len(k[1]) > 1 and lang[k[0]] in ("en", "de")}
    assert "hashpartitioning(doc_id" not in plan(terms)  # only the stop list is made distinct


def test_too_many_stop_words_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "MOST_STOPS", 1)
    with pytest.raises(Exception, match="stop words"):
        D.phrases(docs, F.col("text"), spark.createDataFrame([("a",), ("b",)], "term string"), keys=("doc_id",)).count()


def test_index_and_scan_agree(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(docs, F.col("text"), path)
    index, t = S.Index(spark, path), T.tokens(F.lower("text"))
    scan = lambda c: sorted(r.doc_id for r in docs.where(F.size(t) > 0).where(c).collect())
    keys = lambda df: sorted(r.doc_id for r in df.collect())
    for a, b in (("the", "of"), ("water", "über"), ("deep", "sea"), ("x", "x"), ("the", "state-of")):
        assert keys(index.all_of(a, b)) == scan(T.all_of(t, a, b)) and keys(index.any_of(a, b)) == scan(T.any_of(t, a, b))
        assert keys(index.phrase(a, b)) == scan(T.phrase(t, a, b)) and keys(index.phrase(a, b, "the")) == scan(T.phrase(t, a, b, "the"))
    assert keys(index.without(index.all_of("the"), index.any_of("idiot"))) == scan(T.all_of(t, "the") & T.none_of(t, "idiot"))
    assert keys(index.any_of("nowhere")) == keys(index.phrase("the", "nowhere")) == []
    assert "PushedFilters: [EqualTo(term,the)]" in plan(index.postings("the")).replace("IsNotNull(term), ", "")
    places = {(r.doc_id, r.term): r.positions for r in spark.read.parquet(path).collect()}
    for r in docs.collect():
        for i, w in enumerate(tokens(r.text)):
            assert i in places[r.doc_id, w]


@pytest.mark.parametrize("starts", [100_000, 3])
def test_ten_thousand_terms_at_once(spark, docs, monkeypatch, starts):
    monkeypatch.setattr(D, "MOST_STARTS", starts)
    new = [f"absent{i} sea" for i in range(10_000)] + ["deep sea", "the", "water deep sea", "über the of water deep sea x", "sea absent"]
    got = D.index_terms(docs, F.col("text"), spark.createDataFrame([(w,) for w in new], "term string"))
    want = collections.Counter()
    for r in docs.collect():
        w = tokens(r.text)
        want.update((r.doc_id, x) for n in range(1, 7) for i in range(len(w) - n + 1) if (x := " ".join(w[i : i + n])) in ("deep sea", "the", "water deep sea", "sea absent"))
    assert {(r.doc_id, r.term): r.weight for r in got.collect()} == want
    known = spark.createDataFrame([(r.doc_id, "the") for r in docs.collect()], "doc_id long, term string")
    assert {r.term for r in D.index_terms(docs, F.col("text"), spark.createDataFrame([("the",), ("deep sea",)], "term string"), known).collect()} == {"deep sea"}


def test_stems_know_their_language_and_region(spark):
    rows = [("waters", "en", "water"), ("the", "en", "the"), ("nations", "en", "nat"), ("string", "en", "string"), ("nationales", "fr", "national"), ("gouvernements", "fr", "gouvern"), ("zeitungen", "de", "zeit"), ("krankheiten", "de", "krank"), ("naciones", "es", "nacion"), ("rápidamente", "es", "rápida"), ("waters", "xx", "waters")]
    got = spark.createDataFrame(rows, "w string, lang string, stem string").withColumn("got", T.language_key(F.col("w"), F.col("lang"))).collect()
    for r in got:
        v = T.VOWELS.get(r.lang)
        m = v and len(r.w) > 3 and re.match(rf"^([^{v}]*[{v}]+[^{v}].*?)(?:{T.ENDINGS[r.lang]})$", r.w)
        assert r.got == (m.group(1) if m else r.w)
    assert {r.w: r.got for r in got if r.lang == "de"} == {"zeitungen": "zeit", "krankheiten": "krank"}


def test_groups_by_language_do_not_mix(spark):
    terms = spark.createDataFrame([("en", "waters", 2.0), ("en", "water", 1.0), ("fr", "waters", 5.0), ("de", "zeitung", 1.0), ("de", "zeitungen", 3.0)], "lang string, term string, weight double")
    got = {tuple(r) for r in L.group_by_stem(terms, spark.createDataFrame([], "term string"), T.language_key, lang="lang").collect()}
    assert got == {("en", "waters", "water"), ("de", "zeitungen", "zeitung")}


def test_a_document_that_comes_back_adds_nothing(spark, tmp_path):
    reads = []

    def extract(batch):
        reads.append(1)
        return batch.select("doc_id", F.explode(T.counted(T.tokens("text"))).alias("t")).select("doc_id", "t.*")

    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for part in ([(1, "a b a")], [(2, "b"), (1, "changed text")], [(1, "again"), (3, "c")], [(2, "b")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        incremental.index_stream(spark.readStream.schema("doc_id long, text string").parquet(source), extract, out, log).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a", 2.0), (1, "b", 1.0), (2, "b", 1.0), (3, "c", 1.0)]
    assert len(reads) == 4


def test_recount_by_difference_equals_the_full_one(spark):
    r = random.Random(6)
    rows = sorted({(f"c{d % 2}", d, f"t{r.randrange(16):02}") for d in range(60) for _ in range(r.randint(1, 8))})
    terms = spark.createDataFrame([(*x, float(1 + hash(x[2]) % 3)) for x in rows], "corpus_id string, doc_id long, term string, weight double")
    group = lambda pairs: spark.createDataFrame(pairs, "mainform string, subform string")
    chosen = lambda names: spark.createDataFrame([(n,) for n in names], "term string")
    every = [f"t{i:02}" for i in range(16)]
    old, new = group([("t00", "t01"), ("t02", "t03"), ("t04", "t05")]), group([("t00", "t01"), ("t02", "t05"), ("t06", "t07")])
    for before, after in ((every[:12], every[:12]), (every[:6], every[2:14])):
        first, full = workflow.recount(terms, old, chosen(before)), workflow.recount(terms, new, chosen(after))
        some = workflow.recount_changes(terms, first, old, new, chosen(before), chosen(after))
        for name in ("occurrences", "tfidf", "cooccurrences", "scores"):
            plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (x[c] for c in sorted(x.asDict()))) for x in df.collect())
            assert plain(getattr(some, name)) == plain(getattr(full, name)), name


def test_samples_name_their_documents(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 9 THEN NULL ELSE cast(2000 + id % 3 AS long) END AS y")
    got = D.sample_by_year(rows, F.col("y"), 90)
    assert collections.Counter(r.year for r in got.collect()) == {2000: 30, 2001: 30, 2002: 30}
    assert "Window [row_number" not in plan(got)


def sequential_louvain(edges):
    """Modularity of plain one-vertex-at-a-time moves and contraction."""
    graph = [(s, t, w) for s, t, w in edges]
    total, best = 2 * sum(w for _, _, w in edges), -1.0
    while True:
        near, degree = collections.defaultdict(lambda: collections.defaultdict(float)), collections.defaultdict(float)
        for s, t, w in graph:
            degree[s] += w
            degree[t] += w
            if s != t:
                near[s][t] += w
                near[t][s] += w
        where, size = {v: v for v in degree}, dict(degree)
        moved = True
        while moved:
            moved = False
            for v in sorted(degree):
                size[where[v]] -= degree[v]
                links = collections.defaultdict(float)
                for u, w in near[v].items():
                    links[where[u]] += w
                top = max([*links, where[v]], key=lambda c: (round(links[c] - size.get(c, 0) * degree[v] / total, 9), c == where[v]))
                moved |= top != where[v]
                where[v] = top
                size[top] = size.get(top, 0) + degree[v]
        inside = sum(2 * w for s, t, w in graph if where[s] == where[t]) / total
        score = inside - sum((x / total) ** 2 for x in size.values())
        if score - best < 1e-6:
            return best
        best, merged = score, collections.defaultdict(float)
        for s, t, w in graph:
            merged[tuple(sorted((where[s], where[t])))] += w
        graph = [(s, t, w) for (s, t), w in merged.items()]


def test_communities_are_as_good_as_one_by_one(spark):
    r = random.Random(11)
    block = lambda i: i // 12
    edges = [(f"v{i:02}", f"v{j:02}", float(r.randint(1, 4))) for i in range(60) for j in range(i) if r.random() < (0.5 if block(i) == block(j) else 0.04)]
    table = spark.createDataFrame(edges, "s string, t string, w double").repartition(3)
    levels = G.community_levels(table)
    found = G.modularity(table, G.compose_levels(levels)).first()["modularity"]
    assert found >= 0.99 * sequential_louvain(edges)
    tree = collections.defaultdict(dict)
    for x in G.dendrogram(levels).collect():
        tree[x.level][x.id] = x.cluster
    ids = {v for e in edges for v in e[:2]}
    assert sorted(tree) == list(range(len(levels))) and all(set(tree[k]) == ids for k in tree)
    for k in range(len(levels) - 1):  # a community lies whole in one of the next level
        assert len({(tree[k][v], tree[k + 1][v]) for v in ids}) == len(set(tree[k].values()))
        assert G.modularity(table, spark.createDataFrame(list(tree[k].items()), "id string, cluster string")).first()["modularity"] <= found + 1e-9


@pytest.mark.parametrize("graph", ["cosine", "true_cosine", "distributional"])
def test_bounded_products_give_the_same_graph_from_fewer_pairs(spark, monkeypatch, graph):
    r = random.Random(1)  # four hubs that all know each other, and terms that know two of them
    pairs = [(f"a{i}", f"a{j}", 3) for j in range(4) for i in range(j)] + [(f"a{i}", f"t{j:03}", 3 + (j + i) % 3) for j in range(120) for i in r.sample(range(4), 2)]
    table = spark.createDataFrame(pairs, "a string, b string, weight long")
    build = {"cosine": lambda: G.cosine_graph(table), "true_cosine": lambda: G.cosine_graph(table, True), "distributional": lambda: G.distributional_graph(table)}[graph]
    counts, products = [], G._products

    def bounded(left, right, term, bounds, weigh):
        rows = products(left, right, term, bounds, weigh)
        counts.append(rows.count())
        return rows

    def unbounded(left, right, term, bounds, weigh):
        rows = weigh(left.join(right, "k").where("s <> t").groupBy("s", "t").agg(F.sum(term).alias("value")))
        counts.append(rows.count())
        return rows

    plain = lambda df: sorted((x.s, x.t, round(x.w, 9)) for x in df.collect())
    monkeypatch.setattr(G, "_products", bounded)
    got = plain(build())
    monkeypatch.setattr(G, "_products", unbounded)
    assert got == plain(build())
    assert counts[0] <= counts[1] and (graph != "cosine" or counts[0] < counts[1])

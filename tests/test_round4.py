"""Queries on odd rows and larger tables: paragraphs of another language, pairs counted by blocks, baskets without large broadcasts."""

import collections
import random

import duckdb
import pytest

from termloom.operators import graph as G
from termloom.plans import corpora
from termloom.plans.registry import ORACLES, QUERIES


def test_paragraphs_none_of_which_stay(spark, tmp_path):
    rows = [
        (1, "le chat et les chiens", "en"), (2, "the cat\n\nle chat et les chiens\nx", "en"), (3, "le chat\nthe", None), (4, "", "fr"), (5, None, "en"),
        (6, "the", "fr"), (6, "le les", "en"), (6, "of\nund", "de"), (None, "the", "fr"), (7, "der the", "de"), (8, "the\n \t\n\nLE", "fr"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("b17_paragraph_language", "b17_kept_paragraphs"):
        got = {r.doc_id: (r.kept, r.cut) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        want = {d: (kept, cut) for d, kept, cut in con.sql(f"SELECT doc_id, kept, cut FROM ({ORACLES[name]})").fetchall()}
        assert got == want


@pytest.mark.parametrize("sent", [0, 200_000])
@pytest.mark.parametrize("by", [(), ("corpus_id",)])
def test_pairs_counted_by_blocks(spark, monkeypatch, sent, by):
    monkeypatch.setattr(G, "CELL", 3)
    monkeypatch.setattr(G, "MOST_SENT", sent)
    monkeypatch.setattr(G, "FEW_PAIRS", 0)
    r = random.Random(7)
    rows = [(r.choice("xyz"), r.randrange(60), f"t{r.randrange(23)}", 1.0) for _ in range(900)]
    odd = [(None, 1, "t1", 1.0), ("x", None, "t1", 1.0), ("x", 1, None, 1.0)]
    terms = spark.createDataFrame(rows + odd, "corpus_id string, doc_id long, term string, weight double")
    sets = collections.defaultdict(set)
    for c, d, t, _ in rows + (odd[:1] if not by else []):
        sets[(c, d) if by else d].add(t)
    count = collections.Counter(((k[0], a, b) if by else (a, b)) for k, s in sets.items() for a in s for b in s)
    for half, diagonal in ((True, True), (True, False), (False, True), (False, False)):
        got = [tuple(x) for x in G.cooccurrences(terms, threshold=3, half=half, diagonal=diagonal, by=by).collect()]
        want = {p: n for p, n in count.items() if n >= 3 and (p[-2] <= p[-1] or not half) and (p[-2] != p[-1] or diagonal)}
        assert len(got) == len(want) and {x[:-1]: x[-1] for x in got} == want


def test_pairs_are_not_joined_by_document(spark):
    terms = spark.createDataFrame([("c", 1, "a", 1.0)], "corpus_id string, doc_id long, term string, weight double")
    joins = [line for line in G.cooccurrences(terms)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("doc_id" in line for line in joins)


def test_baskets_broadcast_no_table_that_grows(spark):
    plan = corpora.baskets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("BroadcastHashJoin") == 1  # the nations
    assert "hashpartitioning(doc_id" not in plan  # terms are summed where the lines of an order are


def test_an_order_given_twice_counts_once_a_row(spark, tmp_path):
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.union(rows.where("o_orderkey < 40")) if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in corpora.baskets(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"WITH {corpora.BASKET_SQL} SELECT corpus_id, doc_id, pub_date, term, weight FROM basket").fetchall())

"""Queries on larger tables: the workflow's documents dealt once, tasks of bounded size, rows read once for all figures."""

import re

import pytest
from pyspark.sql import functions as F

from termloom.operators import graph as G
from termloom.operators import metrics as M
from termloom.plans import workflow

ROWS = [
    ("x", 1, "cats", 2.0), ("x", 1, "cat", 1.0), ("x", 1, "dog", 4.0), ("x", 2, "cat", 1.0), ("x", 2, "dogs", 3.0), ("y", 2, "cats", 5.0), ("y", 3, "dog", 1.0),
    ("y", 3, "cat", 2.0), ("y", 3, "owl", 1.0), ("x", 4, "cat", 1.0), ("x", 4, "dog", 2.0), ("x", 4, "the", 9.0), (None, 5, "cat", 1.0), (None, 5, "dogs", 1.0),
    ("x", None, "cat", 7.0), ("x", None, "cats", 1.0), ("x", None, "dog", 3.0), ("z", None, "dog", 2.0), ("y", 6, None, 1.0), ("y", 7, "cat", 1.0), ("y", 7, "dog", 1.0),
]


def rows_of(df):
    return sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())))


@pytest.fixture
def measured(spark):
    terms = spark.createDataFrame(ROWS, "corpus_id string, doc_id long, term string, weight double")
    # dog stands under two forms, so its rows count for both
    groups = spark.createDataFrame([("cat", "cats"), ("dogs", "dog"), ("owl", "dog")], "mainform string, subform string")
    listed = spark.createDataFrame([("cat",), ("dogs",), ("owl",), ("emu",)], "term string")
    return terms, groups, workflow.recount(terms, groups, listed, threshold=2)


def test_documents_dealt_once_give_the_operators_counts(measured):
    terms, groups, made = measured
    inside = terms.where("term IN ('cat', 'cats', 'dog', 'dogs', 'owl')")
    tfidf = M.tfidf_documents(inside, groups=groups).select("corpus_id", "doc_id", "term", "score")
    assert rows_of(made.tfidf) == rows_of(tfidf)
    assert rows_of(made.cooccurrences) == rows_of(G.cooccurrences(inside, groups=groups, threshold=2, by=()))
    assert rows_of(made.occurrences) == rows_of(M.occurrences(terms, groups))


def test_documents_are_not_dealt_by_term(measured):
    plan = measured[2].tfidf._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_a_ranking_of_its_own_scope_reads_it_once_for_its_terms(spark):
    terms = spark.createDataFrame(ROWS, "corpus_id string, doc_id long, term string, weight double")
    one, other = M.tfidf_ranking(terms, terms), M.tfidf_ranking(terms.where(F.lit(True)), terms)
    assert rows_of(one) == rows_of(other)
    assert "Join" not in one._jdf.queryExecution().executedPlan().toString().replace("NestedLoopJoin", "")


def test_matrices_join_no_documents(spark):
    from termloom.plans import list_queries

    plan = list_queries.matrices(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3  # customers, parts and orders; the orders' terms are paired within a row


def test_all_joins_of_baskets_are_in_tasks_of_some_lines(spark, monkeypatch):
    from termloom.plans import corpora

    monkeypatch.setattr(corpora, "LINES", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = corpora.baskets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    tasks = {name: corpora.table(spark, "/root/testdata/sf0.001", name).count() // 100 + 1 for name in ("lineitem", "orders")}
    for key, name in (("l_partkey", "lineitem"), ("p_partkey", "lineitem"), ("l_orderkey", "lineitem"), ("o_orderkey", "lineitem"), ("o_custkey", "orders"), ("c_custkey", "orders")):
        found = re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan)
        assert found and set(found) == {str(tasks[name])}, key


def test_the_recount_of_changes_reads_written_rows(spark, monkeypatch):
    from termloom.plans import graph_queries

    seen = []
    monkeypatch.setattr(workflow, "recount_changes", lambda rows, before, *rest: seen.append(rows) or before)
    graph_queries.k2_changes(spark, "/root/testdata/sf0.001")
    assert all("/termloom-" in path for path in seen[0].inputFiles())


def test_changes_of_odd_rows_count_as_a_whole_recount(measured, spark):
    terms, groups, _ = measured
    flat = groups.where("mainform <> 'owl'")
    old, old_terms = spark.createDataFrame([("cat", "dogs")], "mainform string, subform string"), spark.createDataFrame([("cat",), ("the",)], "term string")
    new_terms = spark.createDataFrame([("cat",), ("dogs",), ("owl",)], "term string")
    made = workflow.recount_changes(terms, workflow.recount(terms, old, old_terms, 1), old, flat, old_terms, new_terms, 1)
    whole = workflow.recount(terms, flat, new_terms, 1)
    for name in ("cooccurrences", "scores", "occurrences", "tfidf"):
        a, b = getattr(made, name), getattr(whole, name)
        assert rows_of(a.select(*sorted(a.columns))) == rows_of(b.select(*sorted(a.columns))), name

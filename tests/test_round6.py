"""Queries on larger tables: pairs counted in matrices, texts split once for each reading."""

import collections

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from termloom.operators import graph as G
from termloom.operators import pairs as P
from termloom.plans import corpora
from termloom.plans.registry import ORACLES, QUERIES

CELLS = pa.schema([(c, pa.int64()) for c in ("first", "i", "j", "width")] + [(c, pa.list_(pa.int16())) for c in ("left", "right")])


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize(("dense", "chunk", "docs"), [(0, 1, 2048), (700, 50, 7), (3, 1 << 17, 1), (10**9, 1, 7)])
def test_cells_count_as_pairs_one_by_one(monkeypatch, dense, chunk, docs, diagonal):
    for name, value in (("DENSE", dense), ("CHUNK", chunk), ("DOCS", docs), ("ROWS", 5)):
        monkeypatch.setattr(P, name, value)
    r, width, rows, want = np.random.default_rng(1), 9, [], collections.Counter()
    some = lambda: r.choice(width, r.integers(0, width + 1), replace=False).tolist()
    for first, i, j in ((0, 0, 0), (0, 0, 1), (18, 0, 0), (18, 1, 2)):
        for _ in range(40):
            left, right = some(), some()
            rows.append((first, i, j, width, left, None if i == j else right))
            want.update((a, b) for x in left for y in (left if i == j else right) if (a := first + i * width + x) <= (b := first + j * width + y) and (diagonal or a < b))
    table = pa.table([list(c) for c in zip(*rows, strict=True)], schema=CELLS)
    got = [row for b in P.counts(iter(table.to_batches(max_chunksize=33)), 3, diagonal) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len(set(got)) and {x[:2]: x[2] for x in got} == {k: n for k, n in want.items() if n >= 3}


@pytest.mark.parametrize("cut", [1, 4, 1000])
def test_documents_are_cut_into_cells(monkeypatch, cut):
    monkeypatch.setattr(P, "CUT", cut)
    rows = [(100, 5, 0, [101, 114, 100, 107, 113]), (100, 5, 1, []), (100, 5, 2, [109]), (7, 3, 0, [15, 7]), (7, 3, 0, [])]
    schema = pa.schema([(c, pa.int64()) for c in ("first", "width", "part")] + [("ids", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    got = [tuple(r.values()) for b in P.cells(iter([batch.slice(0, 0), batch])) for r in b.to_pylist()]
    one = [(100, 0, 0, 0, 5, [1, 0], None), (100, 0, 1, 0, 5, [1, 0], [2]), (100, 0, 2, 0, 5, [1, 0], [4, 3]), (100, 1, 1, 0, 5, [2], None), (100, 1, 2, 0, 5, [2], [4, 3]), (100, 2, 2, 0, 5, [4, 3], None)]
    assert got == [*one, (100, 1, 1, 2, 5, [4], None), (7, 0, 0, 0, 3, [0], None), (7, 0, 2, 0, 3, [0], [2]), (7, 2, 2, 0, 3, [2], None)]


def odd_documents(spark, path):
    """Documents given twice, of no corpus, number or text, and of words of one character; two corpora of 24 terms and one of three."""
    words = [f"w{k}" for k in range(24)]
    rows = [(d, " ".join(words[k] for k in range(24) if (d * (k + 3)) % 7 < 3 + k % 3), f"src{d % 2}") for d in range(40)]
    rows += [(1, "w1 w2 w3 A b c-d W4-w5", "src1"), (1, "w1-w2 w3 w9", "src1"), (4, "w1 w2", None), (None, "w1 w2 w3", "src1"), (5, None, "src1"), (6, "", "src0"), (7, " . ", "src0")]
    rows += [(d, "éa ßb éa x", "src2") for d in range(40, 44)] + [(d, "w1 w2 w3 w4", None) for d in range(50, 54)]
    docs = spark.createDataFrame([(*r[:2], "en", r[2]) for r in rows], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("rows", [1, 150, 10**9])
@pytest.mark.parametrize("few", [0, 2_000_000])
def test_pairs_of_main_lists_of_odd_documents(spark, tmp_path, monkeypatch, few, rows):
    con = odd_documents(spark, tmp_path)
    for name, value in (("CELL", 5), ("FEW_PAIRS", few), ("MOST_ROWS", rows), ("MOST_TASKS", 8)):
        monkeypatch.setattr(G, name, value)
    for name in ("h1_cooccurrences", "d12_graph_size"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        want = con.sql(ORACLES[name]).fetchall()
        assert want and sorted(got) == sorted(want)


def test_no_pair_of_a_document_is_a_row(spark, monkeypatch):
    monkeypatch.setattr(G, "FEW_PAIRS", 0)
    for name in ("h1_cooccurrences", "d12_graph_size"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("MapInArrow", 1)
        assert "Generate" not in above and "Exchange hashpartitioning(a" not in above  # counts are final in their task
        assert "Exchange hashpartitioning(first" in below


@pytest.mark.parametrize("distinct", [True, False])
def test_a_text_is_split_once(spark, distinct):
    rows = corpora.text_words(spark, "/root/testdata/sf0.001", distinct).select("corpus_id", "term")
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") == 1

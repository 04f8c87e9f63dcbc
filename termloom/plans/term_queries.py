"""Queries over document terms: metrics, joins and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import metrics as M
from termloom.operators.storage import checkpointed

from .base import query
from .corpora import BASKET_SQL, TEXT_SQL, basket_groups, basket_list, baskets, table, text_documents, text_terms

six = lambda c: F.round(F.col(c), 6).alias(c)
STOP = ["the", "of", "and", "le", "la", "de", "die", "der", "el", "los"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("d1_occurrences", "SELECT corpus_id, term, sum(weight) AS occurrences FROM doc_terms GROUP BY ALL", TEXT_SQL)
def d1(spark, sf_dir):
    return M.occurrences(text_terms(spark, sf_dir))


@query(
    "d1_occurrences_grouped",
    "SELECT corpus_id, coalesce(mainform, term) AS term, sum(weight) AS occurrences FROM basket LEFT JOIN groups ON term = subform GROUP BY ALL",
    BASKET_SQL,
)
def d1_grouped(spark, sf_dir):
    return M.occurrences(baskets(spark, sf_dir), basket_groups(spark, sf_dir))


RANK_SQL = """
, scope AS MATERIALIZED (SELECT d.* FROM {rows} d WHERE {where}), m AS (SELECT count(DISTINCT doc_id) AS M FROM scope),
ranked AS (SELECT term, sum(weight) AS tf, {nd} AS nd FROM (SELECT s.* REPLACE (coalesce(mainform, term) AS term) FROM scope s LEFT JOIN ({groups}) ON term = subform) GROUP BY term)
"""
NO_GROUPS = "SELECT '' AS mainform, '' AS subform WHERE false"


@query("d2_tfidf_local", "SELECT term, tf, nd, round(tf * (ln(M) - ln(nd)), 6) AS score FROM ranked, m", TEXT_SQL + RANK_SQL.format(rows="doc_terms", where="corpus_id = 'src0'", nd="count(DISTINCT doc_id)", groups=NO_GROUPS))
def d2_local(spark, sf_dir):
    mine = text_terms(spark, sf_dir).where("corpus_id = 'src0'")
    return M.tfidf_ranking(mine, mine).select("term", "tf", "nd", six("score"))


@query(
    "d2_tfidf_global",
    "SELECT term, tf, nd, round(tf * (ln(M) - ln(nd)), 6) AS score FROM ranked SEMI JOIN (SELECT term FROM doc_terms WHERE corpus_id = 'src0') USING (term), m",
    TEXT_SQL + RANK_SQL.format(rows="doc_terms", where="d.corpus_id IN (SELECT corpus_id FROM docs WHERE source_type = 0)", nd="count(DISTINCT doc_id)", groups=NO_GROUPS),
)
def d2_global(spark, sf_dir):
    rows = text_terms(spark, sf_dir)
    kind = text_documents(spark, sf_dir).where("source_type = 0").select("corpus_id").distinct()
    return M.tfidf_ranking(rows.where("corpus_id = 'src0'"), rows.join(F.broadcast(kind), "corpus_id", "left_semi")).select("term", "tf", "nd", six("score"))


@query("d2_tfidf_grouped_rows", "SELECT term, tf, nd, round(tf * (ln(M) - ln(nd)), 6) AS score FROM ranked, m", BASKET_SQL + RANK_SQL.format(rows="basket", where="true", nd="count(*)", groups="SELECT * FROM groups"))
def d2_rows(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    return M.tfidf_ranking(rows, rows, basket_groups(spark, sf_dir), nd="rows").select("term", "tf", "nd", six("score"))


D3_SQL = """
, sizes AS (SELECT corpus_id, count(DISTINCT doc_id) AS N FROM {rows} GROUP BY 1),
tf AS (SELECT corpus_id, doc_id, coalesce(mainform, term) AS term, sum(weight) AS tf FROM {rows} LEFT JOIN ({groups}) ON term = subform GROUP BY ALL),
d3 AS (SELECT corpus_id, doc_id, term, tf * (ln(N) - ln(count(*) OVER (PARTITION BY corpus_id, term))) AS score FROM tf JOIN sizes USING (corpus_id) WHERE {where})
"""


@query("d3_tfidf_documents", "SELECT corpus_id, doc_id, term, round(score, 6) AS score FROM d3", TEXT_SQL + D3_SQL.format(rows="doc_terms", groups=NO_GROUPS, where="true"))
def d3(spark, sf_dir):
    return M.tfidf_documents(text_terms(spark, sf_dir)).withColumn("score", six("score"))


@query("d3_tfidf_documents_list", "SELECT corpus_id, doc_id, term, round(score, 6) AS score FROM d3", BASKET_SQL + D3_SQL.format(rows="basket", groups="SELECT * FROM groups", where="term IN (SELECT p_name FROM part)"))
def d3_list(spark, sf_dir):
    return M.tfidf_documents(baskets(spark, sf_dir), basket_list(spark, sf_dir), basket_groups(spark, sf_dir)).withColumn("score", six("score"))


@query("d4_document_frequency", "SELECT corpus_id, term, count(DISTINCT doc_id) AS df FROM basket WHERE weight > 0 GROUP BY ALL", BASKET_SQL)
def d4(spark, sf_dir):
    return M.document_frequency(baskets(spark, sf_dir))


D5_SQL = """
, corpus_sizes AS (SELECT corpus_id, count(DISTINCT doc_id) AS N FROM {rows} GROUP BY 1),
reps AS (SELECT corpus_id, term, count(DISTINCT doc_id) / N AS r FROM {rows} JOIN corpus_sizes USING (corpus_id) GROUP BY corpus_id, term, N)
"""


@query("d5_representativity", "SELECT corpus_id, term, round(r, 6) AS representativity FROM reps", BASKET_SQL + D5_SQL.format(rows="basket"))
def d5(spark, sf_dir):
    return M.representativity(baskets(spark, sf_dir)).withColumn("representativity", six("representativity"))


@query(
    "d6_compare_corpora",
    """, sides AS (SELECT a.term, b.r / a.r AS ratio FROM reps a LEFT JOIN reps b ON a.term = b.term AND b.corpus_id = 'src2' WHERE a.corpus_id = 'src1')
    SELECT term, round(coalesce(ratio, (SELECT min(ratio) FROM sides)), 6) AS ratio FROM sides""",
    TEXT_SQL + D5_SQL.format(rows="doc_terms"),
)
def d6(spark, sf_dir):
    return M.compare_corpora(text_terms(spark, sf_dir), "src1", "src2").withColumn("ratio", six("ratio"))


@query(
    "d7_growth",
    """, sums AS (SELECT term, sum(weight) FILTER (WHERE pub_date <= DATE '1997-01-01') AS s1, sum(weight) FILTER (WHERE pub_date > DATE '1997-01-01') AS s2 FROM basket
      WHERE pub_date > DATE '1997-01-01' - 365 AND pub_date <= DATE '1998-01-01' GROUP BY term)
    SELECT p_name AS term, coalesce(round(100 * (s2 - s1) / (s2 + s1), 2), 0) AS growth FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN sums ON term = p_name""",
    BASKET_SQL,
)
def d7(spark, sf_dir):
    return M.growth(baskets(spark, sf_dir), basket_list(spark, sf_dir), "1997-01-01", "1998-01-01")


@query("d8_facets", "SELECT coalesce(lang, '_NA_') AS value, count(*) AS n_docs FROM documents GROUP BY 1 UNION ALL SELECT '_ALL_', count(*) FROM documents")
def d8(spark, sf_dir):
    return M.facet(text_documents(spark, sf_dir), "lang")


@query("d9_count_by_field", "SELECT source AS corpus_id, lang, count(*) AS n_docs FROM documents GROUP BY ALL")
def d9(spark, sf_dir):
    return text_documents(spark, sf_dir).groupBy("corpus_id", "lang").agg(F.count("*").alias("n_docs"))


@query("d10_history_month", "SELECT date_trunc('month', pub_date)::TIMESTAMP AS bucket, sum(weight) AS value FROM basket WHERE term LIKE '%PROMO%' GROUP BY 1", BASKET_SQL)
def d10_month(spark, sf_dir):
    return M.history(baskets(spark, sf_dir).where(F.col("term").contains("PROMO")), "pub_date", "month")


@query(
    "d10_history_decade",
    """, a AS (SELECT make_date(CAST(year(pub_date) // 10 * 10 AS BIGINT), 1, 1)::TIMESTAMP AS bucket, count(DISTINCT doc_id)::DOUBLE AS n, count(DISTINCT doc_id) FILTER (WHERE lang = 'en') AS en FROM docs GROUP BY 1)
    SELECT bucket, round(en / n, 6) AS value FROM a WHERE en > 0""",
    TEXT_SQL,
)
def d10_decade(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    return M.history(docs.where("lang = 'en'"), "pub_date", "decade", "documents", divide_by=docs).withColumn("value", six("value"))


@query(
    "d10_history_century",
    "SELECT make_date(CAST((year(pub_date) - 1) // 100 * 100 + 1 AS BIGINT), 1, 1)::TIMESTAMP AS bucket, count(DISTINCT doc_id)::DOUBLE AS value FROM docs GROUP BY 1",
    TEXT_SQL,
)
def d10_century(spark, sf_dir):
    return M.history(text_documents(spark, sf_dir), "pub_date", "century", "documents")


@query(
    "d10_history_filled",
    """, a AS (SELECT date_trunc('day', ts) AS bucket, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1),
    grid AS (SELECT unnest(generate_series((SELECT min(bucket) FROM a)::TIMESTAMP, (SELECT max(bucket) FROM a)::TIMESTAMP, INTERVAL 1 DAY)) AS bucket)
    SELECT grid.bucket::TIMESTAMP AS bucket, round(coalesce(v, 0), 4) AS value FROM grid LEFT JOIN a ON a.bucket = grid.bucket""",
    "dummy AS (SELECT 1 AS one)",
)
def d10_filled(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("weight"))
    return M.history(events, "ts", "day", fill=True).select("bucket", F.round("value", 4).alias("value"))


@query("d11_search_terms", ", f AS (SELECT term, sum(weight) AS weight FROM doc_terms WHERE starts_with(term, 'th') GROUP BY 1) SELECT term, weight, (SELECT count(*) FROM f) AS total FROM f ORDER BY weight DESC, term LIMIT 20 OFFSET 5", TEXT_SQL)
def d11(spark, sf_dir):
    return M.search_terms(text_terms(spark, sf_dir), prefix="th", limit=20, offset=5)


@query("d13_occurrence_distribution", "SELECT corpus_id, occurrences, count(*) AS n_terms FROM (SELECT corpus_id, term, sum(weight) AS occurrences FROM doc_terms GROUP BY ALL) GROUP BY ALL", TEXT_SQL)
def d13(spark, sf_dir):
    return M.occurrence_distribution(text_terms(spark, sf_dir))


@query("d14_child_counts", "SELECT project, coalesce(corpus_id, '_ALL_') AS corpus_id, count(*) AS n_docs FROM docs GROUP BY ROLLUP (project, corpus_id) HAVING project IS NOT NULL", TEXT_SQL)
def d14(spark, sf_dir):
    return M.child_counts(text_documents(spark, sf_dir))


D15_SQL = """
, d15 AS (SELECT year(pub_date) AS period, term, sum(weight) * ln((SELECT count(DISTINCT doc_id) FROM basket) / count(DISTINCT doc_id)) AS score
  FROM basket WHERE term IN (SELECT p_name FROM part) GROUP BY ALL)
"""


@query("d15_period_tfidf", "SELECT period, term, round(score, 6) AS score FROM d15", BASKET_SQL + D15_SQL)
def d15(spark, sf_dir):
    rows = baskets(spark, sf_dir).withColumn("year", F.year("pub_date").cast("long"))
    return M.period_tfidf(rows, basket_list(spark, sf_dir), "year").withColumn("score", six("score"))


@query(
    "d16_period_distance",
    """, norms AS (SELECT period, sqrt(sum(score * score)) AS norm FROM d15 GROUP BY 1)
    SELECT p.period AS p, q.period AS q, round(1 - coalesce((SELECT sum(a.score * b.score) FROM d15 a JOIN d15 b USING (term) WHERE a.period = p.period AND b.period = q.period) / (p.norm * q.norm), 0), 6) AS distance
    FROM norms p JOIN norms q ON p.period < q.period""",
    BASKET_SQL + D15_SQL,
)
def d16(spark, sf_dir):
    rows = baskets(spark, sf_dir).withColumn("year", F.year("pub_date").cast("long"))
    return M.period_distance(checkpointed(M.period_tfidf(rows, basket_list(spark, sf_dir), "year"))).withColumn("distance", six("distance"))


D17_SQL = f"""
, words AS (SELECT year(pub_date) AS slice, t.corpus_id, term, sum(weight) AS n FROM doc_terms t JOIN docs USING (doc_id) WHERE NOT regexp_matches(term, '^[0-9]') AND term NOT IN ({STOP_SQL}) GROUP BY ALL)
"""


@query("d17_relative_frequency", "SELECT term, round(sum(n) / (SELECT sum(n) FROM words), 9) AS frequency, sum(n) AS n, (SELECT sum(n) FROM words) AS total FROM words GROUP BY term", TEXT_SQL + D17_SQL)
def d17(spark, sf_dir):
    return M.relative_frequency(text_terms(spark, sf_dir), STOP).withColumn("frequency", F.round("frequency", 9))


@query(
    "d18_specificities",
    """, f AS (SELECT corpus_id, term, sum(n) AS n FROM words WHERE corpus_id IN ('src1', 'src2') GROUP BY ALL),
    top AS (SELECT corpus_id, term, n, row_number() OVER (PARTITION BY corpus_id ORDER BY n DESC, term) AS r, count(*) OVER (PARTITION BY corpus_id) AS m FROM f)
    SELECT term, n FROM top WHERE corpus_id = 'src1' AND r <= round_even(m * 10 / 100, 0) AND term NOT IN (SELECT term FROM top WHERE corpus_id = 'src2' AND r <= round_even(m * 10 / 100, 0))""",
    TEXT_SQL + D17_SQL,
)
def d18(spark, sf_dir):
    rows = text_terms(spark, sf_dir)
    one, other = (M.relative_frequency(rows.where(F.col("corpus_id") == c), STOP) for c in ("src1", "src2"))
    return M.specificities(one, other, 10).select("term", "n")


@query(
    "d19_historic_specificity",
    """, f AS (SELECT slice, term, sum(n) / sum(sum(n)) OVER (PARTITION BY slice) AS f FROM words GROUP BY slice, term), s AS (SELECT DISTINCT slice FROM f),
    g AS (SELECT slice, term, whole FROM s, (SELECT term, sum(f) AS whole FROM f GROUP BY 1))
    SELECT slice, term, round(coalesce(f, 0) - whole / (SELECT count(*) FROM s), 9) AS specificity FROM g LEFT JOIN f USING (slice, term)""",
    TEXT_SQL + D17_SQL,
)
def d19(spark, sf_dir):
    years = text_documents(spark, sf_dir).select("doc_id", F.year("pub_date").cast("long").alias("slice"))
    f = checkpointed(M.relative_frequency(text_terms(spark, sf_dir).join(years, "doc_id"), STOP, ("slice",)))
    out = M.historic_specificity(f, f.select("slice").distinct())
    return out.withColumn("specificity", F.round("specificity", 9))


@query(
    "d20_homogeneity",
    """, s AS (SELECT doc_id, year(pub_date) AS slice FROM docs), rows AS (SELECT slice, doc_id, term, weight FROM doc_terms JOIN s USING (doc_id)),
    fresh AS (SELECT slice, count(*) AS n FROM (SELECT term, min(slice) AS slice FROM rows GROUP BY 1) GROUP BY 1)
    SELECT slice, round(sum(weight) * count(DISTINCT doc_id) / count(DISTINCT term), 6) AS homogeneity, coalesce(any_value(n), 0) AS new_terms, CAST(sum(coalesce(any_value(n), 0)) OVER (ORDER BY slice) AS BIGINT) AS vocabulary
    FROM rows LEFT JOIN fresh USING (slice) GROUP BY slice""",
    TEXT_SQL,
)
def d20(spark, sf_dir):
    years = text_documents(spark, sf_dir).select("doc_id", F.year("pub_date").cast("long").alias("slice"))
    return M.homogeneity(text_terms(spark, sf_dir), years).withColumn("homogeneity", six("homogeneity"))

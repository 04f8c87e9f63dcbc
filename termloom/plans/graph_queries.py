"""Queries over co-occurrences and term graphs, and the whole workflow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from termloom.operators import graph as G
from termloom.operators import lists as L
from termloom.operators import metrics as M
from termloom.operators.storage import checkpointed, ranked, staged

from . import workflow
from .base import query
from .corpora import BASKET_SQL, TEXT_SQL, basket_groups, basket_list, baskets, table, text_documents, text_terms, text_words
from .list_queries import E1_SQL, F1_SQL, NAMES, stop_list
from .term_queries import STOP_SQL, six
from .text_queries import STEM_KEY_SQL

H1_SQL = """
, listed AS (SELECT DISTINCT corpus_id, doc_id, term FROM doc_terms SEMI JOIN main USING (corpus_id, term)),
cooc AS (SELECT x.corpus_id, x.term AS a, y.term AS b, count(*) AS weight FROM listed x JOIN listed y USING (corpus_id, doc_id) WHERE x.term <= y.term GROUP BY ALL HAVING count(*) >= 3)
"""


def listed_pairs(spark, sf_dir):
    """(corpus_id, a, b, weight): pairs of the main lists' terms (H1).

    Texts are read twice, for the lists and for the documents' listed terms, which are written once as one row of numbers a document.
    """
    ranking = staged(text_words(spark, sf_dir).groupBy("corpus_id", "term").agg(F.count("*").cast("double").alias("score")))
    main = checkpointed(L.main_list(ranking, F.broadcast(stop_list(spark))).select("corpus_id", "term"))
    ids = ranked(main, "corpus_id", "term", name="id")
    sent = F.broadcast if ids.count() <= G.MOST_SENT else lambda df: df
    known = text_words(spark, sf_dir, distinct=True).where("corpus_id is not null and doc_id is not null")
    found = known.join(sent(ids), ["corpus_id", "term"]).select("corpus_id", "doc_id", F.col("id").cast("int"))
    docs = staged(found.groupBy("corpus_id", "doc_id").agg(F.array_distinct(F.collect_list("id")).alias("ids")))
    return G.numbered_cooccurrences(docs, ids, by=("corpus_id",))


@query("h1_cooccurrences", "SELECT * FROM cooc", TEXT_SQL + E1_SQL + H1_SQL)
def h1(spark, sf_dir):
    return listed_pairs(spark, sf_dir)


H2_SQL = f"""
, names AS (SELECT DISTINCT corpus_id, doc_id, coalesce(mainform, term) AS term FROM basket LEFT JOIN groups ON term = subform WHERE term NOT LIKE 'Brand%1'),
pairs AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM names x JOIN names y USING (doc_id) WHERE x.term < y.term GROUP BY ALL HAVING count(*) >= 3)
"""


@query("h2_cooccurrences_main_forms", "SELECT * FROM pairs", BASKET_SQL + H2_SQL)
def h2(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    stop = rows.select("term").distinct().where("term LIKE 'Brand%1'")
    return G.cooccurrences(rows.join(stop, "term", "left_anti"), groups=basket_groups(spark, sf_dir), diagonal=False, by=())


H3_SQL = f"""
, named AS (SELECT DISTINCT doc_id, term FROM basket WHERE term IN {NAMES} AND pub_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'),
pairs AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM named x JOIN named y USING (doc_id) WHERE x.term < y.term GROUP BY ALL HAVING count(*) >= 3)
"""


def name_pairs(spark, sf_dir):
    """Pairs of part names in the orders of three years (H3)."""
    rows = baskets(spark, sf_dir).where(M.between("pub_date", "1996-01-01", "1998-12-31"))
    return G.cooccurrences(rows, basket_list(spark, sf_dir), diagonal=False, by=())


@query("h3_graph_cooccurrences", "SELECT * FROM pairs", BASKET_SQL + H3_SQL)
def h3(spark, sf_dir):
    return name_pairs(spark, sf_dir)


@query("h4_field_cooccurrences", ", f AS (SELECT DISTINCT doc_id, term FROM doc_terms) SELECT lang AS value, term, count(*) AS weight FROM docs JOIN f USING (doc_id) GROUP BY ALL HAVING count(*) >= 3", TEXT_SQL)
def h4(spark, sf_dir):
    return G.field_cooccurrences(text_documents(spark, sf_dir), "lang", text_terms(spark, sf_dir))


SCORES_SQL = """
, full_ AS (SELECT x.term AS i, y.term AS j, count(*) AS n FROM named x JOIN named y USING (doc_id) GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT i, j, f.n / d.n AS p FROM full_ f JOIN (SELECT i AS j, n FROM full_ WHERE i = j) d USING (j)),
sums AS (SELECT term, sum(g) AS gen, sum(s) AS spec FROM (SELECT i AS term, p AS g, 0 AS s FROM p UNION ALL SELECT j, 0, p FROM p) GROUP BY 1)
"""
H5_SQL = f", named AS (SELECT DISTINCT doc_id, term FROM basket WHERE term IN {NAMES})" + SCORES_SQL


@query("h5_specificity", "SELECT term, round(gen, 3) AS gen, round(spec, 3) AS spec, round(spec - gen, 3) AS specclusion, round(spec + gen, 3) AS genclusion FROM sums", BASKET_SQL + H5_SQL)
def h5(spark, sf_dir):
    return G.specificity(checkpointed(G.cooccurrences(baskets(spark, sf_dir), basket_list(spark, sf_dir), by=())))


def map_sql(subforms: str, mono: tuple[int, int], multi: tuple[int, int]) -> str:
    """Picks from ``sums``: numbers by specclusion and by genclusion, of single words and of longer terms."""
    return f"""
    , pool AS (SELECT term, round(spec - gen, 3) AS spec, round(spec + gen, 3) AS gen, instr(term, ' ') = 0 AS mono FROM sums WHERE term NOT IN (SELECT subform FROM {subforms})),
    s AS (SELECT term FROM pool QUALIFY row_number() OVER (PARTITION BY mono ORDER BY spec DESC, term) <= CASE WHEN mono THEN {mono[0]} ELSE {multi[0]} END),
    g AS (SELECT term FROM pool WHERE term NOT IN (SELECT term FROM s) QUALIFY row_number() OVER (PARTITION BY mono ORDER BY gen DESC, term) <= CASE WHEN mono THEN {mono[1]} ELSE {multi[1]} END)
    SELECT term, 'spec' AS picked_by FROM s UNION ALL SELECT term, 'gen' FROM g"""


@query("e2_map_list", ", named AS (SELECT DISTINCT doc_id, term FROM basket)" + SCORES_SQL + map_sql("groups", (2, 2), (6, 10)), BASKET_SQL)
def e2(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    scores = checkpointed(G.specificity(checkpointed(G.cooccurrences(rows, by=()))))
    return L.map_list(scores, rows.select("term").distinct(), basket_groups(spark, sf_dir), limit=20)


FULL_SQL = """
, full_ AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs), sums AS (SELECT a AS v, CAST(sum(weight) AS DOUBLE) AS s FROM full_ GROUP BY 1)
"""


@query(
    "h6_conditional_graph",
    """, p AS (SELECT a, b, weight / s AS w FROM full_ JOIN sums ON a = v), least_ AS (SELECT min(top) AS x FROM (SELECT max(w) AS top FROM p GROUP BY a)),
    k AS (SELECT * FROM p, least_ WHERE w >= x)
    SELECT least(a, b) AS s, greatest(a, b) AS t, round(coalesce(max(w) FILTER (WHERE a > b), max(w) FILTER (WHERE a < b)), 6) AS w FROM k GROUP BY 1, 2""",
    BASKET_SQL + H3_SQL + FULL_SQL,
)
def h6(spark, sf_dir):
    return G.conditional_graph(name_pairs(spark, sf_dir)).withColumn("w", six("w"))


STRONGER_SQL = """
, bound AS (SELECT min(greatest(0, coalesce(top, 0))) AS x FROM sums LEFT JOIN (SELECT j, max(w) AS top FROM r GROUP BY 1) ON v = j)
SELECT least(r.i, r.j) AS s, greatest(r.i, r.j) AS t, round(r.w, 6) AS w FROM r LEFT JOIN r q ON r.i = q.j AND r.j = q.i, bound WHERE r.w > x AND r.w > coalesce(q.w, 0)
"""


@query(
    "h7_cosine_graph",
    """, dots AS (SELECT x.a AS i, y.a AS j, sum(x.weight * y.weight) AS dot FROM full_ x JOIN full_ y USING (b) WHERE x.a <> y.a GROUP BY ALL),
    r AS (SELECT i, j, coalesce(dot / nullif(s - coalesce(weight, 0), 0), 0) AS w FROM dots JOIN sums ON v = i LEFT JOIN full_ ON a = i AND b = j)"""
    + STRONGER_SQL,
    BASKET_SQL + H3_SQL + FULL_SQL,
)
def h7(spark, sf_dir):
    return G.cosine_graph(name_pairs(spark, sf_dir)).withColumn("w", six("w"))


@query(
    "h8_distributional_graph",
    """, mi AS (SELECT a, b, ln(weight * (SELECT sum(s) FROM sums) / (x.s * y.s)) AS mi FROM full_ JOIN sums x ON a = x.v JOIN sums y ON b = y.v),
    o AS (SELECT x.a AS i, y.a AS j, sum(least(x.mi, y.mi)) AS o FROM mi x JOIN mi y USING (b) WHERE x.mi > 0 AND x.a <> y.a GROUP BY ALL),
    h AS (SELECT a, sum(mi) AS h FROM mi WHERE mi > 0 GROUP BY 1),
    r AS (SELECT i, j, coalesce(o / nullif(h - coalesce(m.mi, 0), 0), 0) AS w FROM o JOIN h ON h.a = i LEFT JOIN mi m ON m.a = i AND m.b = j AND m.mi > 0)"""
    + STRONGER_SQL,
    BASKET_SQL + H3_SQL + FULL_SQL,
)
def h8(spark, sf_dir):
    return G.distributional_graph(name_pairs(spark, sf_dir)).withColumn("w", six("w"))


H6_EDGES = """
, p AS (SELECT a, b, weight / s AS w FROM full_ JOIN sums ON a = v), least_ AS (SELECT min(top) AS x FROM (SELECT max(w) AS top FROM p GROUP BY a)),
edges AS (SELECT least(a, b) AS s, greatest(a, b) AS t, coalesce(max(w) FILTER (WHERE a > b), max(w) FILTER (WHERE a < b)) AS w FROM p, least_ WHERE w >= x GROUP BY 1, 2),
part_ AS (SELECT DISTINCT v AS id, split_part(v, ' ', 2) AS cluster FROM sums)
"""


def graph(spark, sf_dir):
    pairs = name_pairs(spark, sf_dir)
    edges = G.conditional_graph(pairs)
    partition = basket_list(spark, sf_dir).select(F.col("term").alias("id"), F.split_part("term", F.lit(" "), F.lit(2)).alias("cluster"))
    return pairs, edges, partition


GRAPH_SQL = BASKET_SQL + H3_SQL + FULL_SQL + H6_EDGES


@query("h10_node_weights", "SELECT a AS id, CAST(sum(weight) AS BIGINT) AS size FROM full_ WHERE a IN (SELECT s FROM edges UNION SELECT t FROM edges) GROUP BY 1", GRAPH_SQL)
def h10(spark, sf_dir):
    pairs, edges, _ = graph(spark, sf_dir)
    return G.node_weights(pairs, edges)


@query(
    "h11_modularity",
    """, r AS (SELECT w, x.cluster AS cs, y.cluster AS ct FROM edges JOIN part_ x ON s = x.id JOIN part_ y ON t = y.id), d AS (SELECT c, sum(w) AS d FROM (SELECT cs AS c, w FROM r UNION ALL SELECT ct, w FROM r) GROUP BY 1),
    i AS (SELECT cs AS c, sum(w) AS i FROM r WHERE cs = ct GROUP BY 1), m AS (SELECT sum(w) AS m FROM edges)
    SELECT round(sum(coalesce(i, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), m""",
    GRAPH_SQL,
)
def h11(spark, sf_dir):
    _, edges, partition = graph(spark, sf_dir)
    return G.modularity(edges, partition).withColumn("modularity", six("modularity"))


def own_communities(spark, sf_dir):
    """The edges of the conditional graph and the levels of their communities."""
    edges = checkpointed(graph(spark, sf_dir)[1])
    return edges, G.community_levels(edges)


@query("h12_communities")
def h12(spark, sf_dir):
    return G.compose_levels(own_communities(spark, sf_dir)[1])


@query(
    "h13_partition_level",
    "SELECT count(*) AS vertices, count(*) AS placed, true AS once, true AS gained, true AS nested FROM (SELECT s FROM edges UNION SELECT t FROM edges)",
    GRAPH_SQL,
)
def h13(spark, sf_dir):
    """Invariants of the levels: every vertex is in one community of the last, whose modularity is not below that of single vertices,
    and communities of the first level lie whole in those of the last."""
    edges, levels = own_communities(spark, sf_dir)
    first, found = G.compose_levels(levels[:1]), G.compose_levels(levels)
    alive = edges.select(F.col("s").alias("id")).union(edges.select("t")).distinct()
    counts = alive.join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "full").agg(F.count("*").alias("vertices"), F.count("n").alias("placed"), F.min(F.coalesce("n", F.lit(0)) == 1).alias("once"))
    score = lambda p, name: G.modularity(edges, p).withColumnRenamed("modularity", name)
    parts = first.join(found.withColumnRenamed("cluster", "whole"), "id").groupBy("cluster").agg(F.countDistinct("whole").alias("parts")).agg(F.max("parts").alias("parts"))
    every = counts.crossJoin(score(found, "found")).crossJoin(score(alive.withColumn("cluster", F.col("id")), "single")).crossJoin(parts)
    return every.select("vertices", "placed", "once", (F.col("found") >= F.col("single")).alias("gained"), (F.col("parts") == 1).alias("nested"))


@query("h13_dendrogram")
def h13_dendrogram(spark, sf_dir):
    return G.dendrogram(own_communities(spark, sf_dir)[1])


@query("h9_min_max", """, p AS (SELECT a, b, weight / s AS w FROM full_ JOIN sums ON a = v) SELECT round(min(greatest(0, coalesce(top, 0))), 6) AS threshold FROM sums LEFT JOIN (SELECT b, max(w) AS top FROM p GROUP BY 1) ON v = b""", BASKET_SQL + H3_SQL + FULL_SQL)
def h9(spark, sf_dir):
    full = checkpointed(G.mirrored(name_pairs(spark, sf_dir)))
    sums = G.row_sums(full)
    p = full.join(sums, full["a"] == sums["v"]).select(F.col("a").alias("s"), F.col("b").alias("t"), (F.col("weight") / F.col("sum")).alias("w"))
    return G.min_max(p, sums).withColumn("threshold", six("threshold"))


@query("c5_self_join", ", x AS (SELECT DISTINCT doc_id, term FROM basket) SELECT l.term AS a, r.term AS b, count(*) AS weight FROM x l JOIN x r USING (doc_id) WHERE l.term <= r.term GROUP BY ALL", BASKET_SQL)
def c5(spark, sf_dir):
    return G.cooccurrences(baskets(spark, sf_dir), threshold=1, by=())


@query(
    "h14_prune_bridges",
    """, r AS (SELECT s, t, w, least(x.cluster, y.cluster) AS c1, greatest(x.cluster, y.cluster) AS c2 FROM edges JOIN part_ x ON s = x.id JOIN part_ y ON t = y.id),
    n AS (SELECT cluster, count(*) AS n FROM part_ GROUP BY 1),
    q AS (SELECT c1, c2, round_even(5.0 * count(*) / (any_value(x.n) + any_value(y.n)), 0) AS most FROM r JOIN n x ON c1 = x.cluster JOIN n y ON c2 = y.cluster WHERE c1 <> c2 GROUP BY 1, 2)
    SELECT s, t, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY w DESC, s, t) AS place FROM r) LEFT JOIN q USING (c1, c2) WHERE c1 = c2 OR place <= most""",
    GRAPH_SQL,
)
def h14(spark, sf_dir):
    _, edges, partition = graph(spark, sf_dir)
    return G.prune_bridges(edges, partition, 5).withColumn("w", six("w"))


@query("h15_graph_nodes", "SELECT a AS id, a AS label, CAST(sum(weight) AS BIGINT) AS size, split_part(a, ' ', 2) AS cluster FROM full_ WHERE a IN (SELECT s FROM edges UNION SELECT t FROM edges) GROUP BY 1", GRAPH_SQL)
def h15(spark, sf_dir):
    return G.assemble(*graph(spark, sf_dir))


@query("h16_preconditions", f"SELECT (SELECT count(*) FROM {NAMES}) AS n_terms, count(*) AS n_docs, (SELECT count(*) FROM {NAMES}) >= 50 AND count(*) > 0 AS enough FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'")
def h16(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= date '1997-01-01' AND o_orderdate < date '1998-01-01'")
    return G.preconditions(basket_list(spark, sf_dir), orders)


@query(
    "h17_neighbourhood",
    """, e AS (SELECT s AS f, t AS id, w FROM edges UNION ALL SELECT t, s, w FROM edges), c AS (SELECT DISTINCT p_name AS term FROM part WHERE p_name LIKE 'b%')
    SELECT id, count(*) AS touched, round(sum(w), 6) AS weight FROM e WHERE f IN (SELECT term FROM c) AND id NOT IN (SELECT term FROM c) GROUP BY 1""",
    GRAPH_SQL,
)
def h17(spark, sf_dir):
    _, edges, _ = graph(spark, sf_dir)
    return G.neighbourhood(edges, basket_list(spark, sf_dir).where("term LIKE 'b%'")).withColumn("weight", six("weight"))


@query("e7_equal_slices", ", x AS (SELECT *, row_number() OVER (ORDER BY w, s, t) AS p, count(*) OVER () AS n FROM edges) SELECT s, t, CAST(floor((p - 1) / greatest(1, round(n / greatest(1, round(sqrt(n)))))) AS BIGINT) AS slice FROM x", GRAPH_SQL)
def e7(spark, sf_dir):
    _, edges, _ = graph(spark, sf_dir)
    return L.equal_slices(edges, "w", "s", "t").select("s", "t", "slice")


@query("d12_graph_size", "SELECT corpus_id, count(*) AS n_terms FROM (SELECT corpus_id, a FROM cooc GROUP BY ALL HAVING count(*) > 1) GROUP BY 1", TEXT_SQL + E1_SQL + H1_SQL)
def d12(spark, sf_dir):
    return G.graph_size(listed_pairs(spark, sf_dir))


@query("a20_graph_export", "SELECT s, t, round(w, 3) AS w FROM edges", GRAPH_SQL)
def a20(spark, sf_dir):
    _, edges, _ = graph(spark, sf_dir)
    return workflow.graph_links(edges)


@query(
    "a20_graph_nodes",
    """SELECT CAST(to_json(struct_pack(id := a, lb := a, s := CAST(sum(weight) AS BIGINT), at := struct_pack(cl := split_part(a, ' ', 2)))) AS VARCHAR) AS json
    FROM full_ WHERE a IN (SELECT s FROM edges UNION SELECT t FROM edges) GROUP BY a""",
    GRAPH_SQL,
)
def a20_nodes(spark, sf_dir):
    return workflow.graph_nodes_json(G.assemble(*graph(spark, sf_dir)))


K1_SQL = f"""
, stops AS (SELECT DISTINCT term FROM basket WHERE term IN ({STOP_SQL}) OR regexp_matches(term, '^{F1_SQL}')),
freq AS (SELECT term, sum(weight) AS f FROM basket WHERE term NOT IN (SELECT term FROM stops) GROUP BY 1),
led AS (SELECT first_value(term) OVER (PARTITION BY key ORDER BY f DESC, term) AS mainform, term AS subform FROM (SELECT term, f, {STEM_KEY_SQL} AS key FROM freq)),
alike AS (SELECT * FROM led WHERE mainform <> subform),
formed AS (SELECT doc_id, coalesce(mainform, term) AS term, weight FROM basket LEFT JOIN alike ON term = subform),
ranked AS (SELECT term, sum(weight) * (ln((SELECT count(DISTINCT doc_id) FROM basket)) - ln(count(DISTINCT doc_id))) AS score FROM formed WHERE term NOT IN (SELECT term FROM stops) GROUP BY 1),
main AS (SELECT term FROM (SELECT term, row_number() OVER (ORDER BY score DESC, term) AS r, count(*) OVER () AS n FROM ranked) WHERE r <= least(5000, round_even(n * 0.75, 0))),
listed AS (SELECT term FROM main UNION SELECT subform FROM alike WHERE mainform IN (SELECT term FROM main)),
named AS (SELECT DISTINCT doc_id, coalesce(mainform, term) AS term FROM basket LEFT JOIN alike ON term = subform WHERE term IN (SELECT term FROM listed))
"""


@query("k1_workflow", K1_SQL + SCORES_SQL + map_sql("alike", (3, 5), (13, 19)), BASKET_SQL)
def k1(spark, sf_dir):
    return workflow.corpus_workflow(baskets(spark, sf_dir), None, stop_list(spark), map_limit=40).map_list


K1_ROWS = """
SELECT 'occurrences' AS output, term AS a, '' AS b, round(sum(weight), 6) AS x FROM formed GROUP BY corpus_id, term
UNION ALL SELECT 'main', term, '', 0 FROM main
UNION ALL SELECT 'tfidf', term, CAST(doc_id AS VARCHAR), round(tf * (ln(n) - ln(nd)), 6) FROM (
    SELECT corpus_id, doc_id, term, sum(weight) AS tf, count(*) OVER (PARTITION BY corpus_id, term) AS nd FROM listed_rows GROUP BY corpus_id, doc_id, term) JOIN (SELECT corpus_id, count(DISTINCT doc_id) AS n FROM listed_rows GROUP BY 1) USING (corpus_id)
UNION ALL SELECT 'pairs', x.term, y.term, count(*) FROM named x JOIN named y USING (doc_id) WHERE x.term <= y.term GROUP BY x.term, y.term HAVING count(*) >= 3
UNION ALL SELECT 'scores', term, '', round(spec + gen, 3) FROM sums
"""


@query(
    "k1_outputs",
    K1_SQL.replace("formed AS (SELECT doc_id,", "formed AS (SELECT corpus_id, doc_id,") + ", listed_rows AS (SELECT corpus_id, doc_id, coalesce(mainform, term) AS term, weight FROM basket LEFT JOIN alike ON term = subform WHERE term IN (SELECT term FROM listed))" + SCORES_SQL + K1_ROWS,
    BASKET_SQL,
)
def k1_outputs(spark, sf_dir):
    """All outputs of the workflow but the map list, which is k1_workflow's."""
    made = workflow.corpus_workflow(baskets(spark, sf_dir), None, stop_list(spark), map_limit=40)
    none, zero = F.lit("").alias("b"), F.lit(0.0).alias("x")
    parts = [
        made.occurrences.select(F.lit("occurrences").alias("output"), F.col("term").alias("a"), none, six("occurrences").alias("x")),
        made.main_list.select(F.lit("main").alias("output"), F.col("term").alias("a"), none, zero),
        made.tfidf.select(F.lit("tfidf").alias("output"), F.col("term").alias("a"), F.col("doc_id").cast("string").alias("b"), six("score").alias("x")),
        made.cooccurrences.select(F.lit("pairs").alias("output"), "a", "b", F.col("weight").cast("double").alias("x")),
        made.scores.select(F.lit("scores").alias("output"), F.col("term").alias("a"), none, F.col("genclusion").alias("x")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


K2_SQL = f", named AS (SELECT DISTINCT doc_id, coalesce(mainform, term) AS term FROM basket LEFT JOIN groups ON term = subform WHERE term IN {NAMES})" + SCORES_SQL


@query("k2_recount", "SELECT term, round(gen, 3) AS gen, round(spec, 3) AS spec, round(spec - gen, 3) AS specclusion, round(spec + gen, 3) AS genclusion FROM sums", BASKET_SQL + K2_SQL)
def k2(spark, sf_dir):
    groups, names = basket_groups(spark, sf_dir), basket_list(spark, sf_dir)
    return workflow.recount(baskets(spark, sf_dir), groups, names.join(groups, names["term"] == groups["subform"], "left_anti")).scores


@query("k2_recount_changes", "SELECT term, round(gen, 3) AS gen, round(spec, 3) AS spec, round(spec - gen, 3) AS specclusion, round(spec + gen, 3) AS genclusion FROM sums", BASKET_SQL + K2_SQL)
def k2_changes(spark, sf_dir):
    """From the counts of fewer groups and a shorter list, to those of k2_recount, over rows that are written once."""
    rows, groups, names = staged(baskets(spark, sf_dir)), basket_groups(spark, sf_dir), basket_list(spark, sf_dir)
    old = groups.where("mainform < 'c'")
    free = lambda g: names.join(g, names["term"] == g["subform"], "left_anti")
    old_terms = free(old).where("term NOT LIKE 'a%'")
    before = workflow.recount(rows, old, old_terms)
    return workflow.recount_changes(rows, before, old, groups, old_terms, free(groups)).scores


@query("k3_yearly_occurrences", f"SELECT year(pub_date) AS year, term, sum(weight) AS occurrences FROM basket WHERE term IN {NAMES} GROUP BY ALL", BASKET_SQL)
def k3(spark, sf_dir):
    rows = baskets(spark, sf_dir).withColumn("year", F.year("pub_date").cast("long"))
    return M.occurrences(rows.join(basket_list(spark, sf_dir), "term", "left_semi"), by=("year",))

"""Queries over term lists: joins, rankings, stop terms, groups, the algebra and the life cycle of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import lists as L
from termloom.operators import metrics as M
from termloom.operators.storage import checkpointed

from .base import query
from .corpora import BASKET_SQL, LANGUAGE_KEY_SQL, TEXT_SQL, basket_groups, basket_list, baskets, table, text_documents, text_terms
from .term_queries import D3_SQL, NO_GROUPS, STOP, STOP_SQL, six

NAMES = "(SELECT DISTINCT p_name AS term FROM part)"
KINDS = "(SELECT DISTINCT unnest([p_brand, p_type]) AS term FROM part)"


def stop_list(spark):
    return spark.createDataFrame([(w,) for w in STOP], "term string")


@query("c1_membership", f"SELECT corpus_id, doc_id, term, weight FROM basket WHERE term IN {NAMES}", BASKET_SQL)
def c1(spark, sf_dir):
    return baskets(spark, sf_dir).join(basket_list(spark, sf_dir), "term", "left_semi").select("corpus_id", "doc_id", "term", "weight")


@query("c2_stop_exclusion", f"SELECT * FROM doc_terms WHERE term NOT IN ({STOP_SQL})", TEXT_SQL)
def c2(spark, sf_dir):
    return L.difference(text_terms(spark, sf_dir), F.broadcast(stop_list(spark))).select("corpus_id", "doc_id", "term", "weight")


@query("c4_main_forms", "SELECT corpus_id, doc_id, coalesce(mainform, term) AS term, weight FROM basket LEFT JOIN groups ON term = subform", BASKET_SQL)
def c4(spark, sf_dir):
    return M.substitute(baskets(spark, sf_dir), basket_groups(spark, sf_dir)).select("corpus_id", "doc_id", "term", "weight")


@query("c6_list_scores", f"SELECT term, occ FROM {NAMES} LEFT JOIN (SELECT term, sum(weight) AS occ FROM basket WHERE corpus_id = 'NATION_7' GROUP BY 1) USING (term)", BASKET_SQL)
def c6(spark, sf_dir):
    occ = M.occurrences(baskets(spark, sf_dir).where("corpus_id = 'NATION_7'"), by=()).withColumnRenamed("occurrences", "occ")
    return L.with_scores(basket_list(spark, sf_dir), occ)


@query("c7_project_documents", "SELECT project, source_type, corpus_id, doc_id FROM docs WHERE project = 2 OR source_type = 1", TEXT_SQL)
def c7(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    corpora = docs.select("corpus_id", "project", "source_type").distinct().where("project = 2 OR source_type = 1")
    return docs.select("corpus_id", "doc_id").join(F.broadcast(corpora), "corpus_id").select("project", "source_type", "corpus_id", "doc_id")


@query(
    "c8_annotations",
    f""", lists AS (SELECT term, 'map' AS list_name FROM {KINDS} UNION ALL SELECT term, 'main' FROM {KINDS} UNION ALL SELECT DISTINCT mainform, 'main' FROM groups),
    led AS (SELECT doc_id, term, mainform AS "group", weight, coalesce(mainform, term) AS form FROM basket LEFT JOIN groups ON term = subform)
    SELECT doc_id, led.term, "group", weight, list_name FROM led JOIN lists ON form = lists.term WHERE list_name = 'map' OR led.term NOT IN {KINDS}""",
    BASKET_SQL,
)
def c8(spark, sf_dir):
    groups, kinds = basket_groups(spark, sf_dir), basket_list(spark, sf_dir, "kind")
    main = L.union(kinds, groups.select(F.col("mainform").alias("term"))).select("term", F.lit("main").alias("list_name"))
    lists = kinds.select("term", F.lit("map").alias("list_name")).unionByName(main)
    return L.annotate(baskets(spark, sf_dir), lists, groups)


@query("c9_date_range", "SELECT count(*) AS n, sum(weight) AS weight FROM basket WHERE pub_date > DATE '1996-03-01' AND pub_date <= DATE '1997-03-01'", BASKET_SQL)
def c9(spark, sf_dir):
    rows = baskets(spark, sf_dir).withColumn("pub_date", F.col("pub_date").cast("string")).where(M.between("pub_date", "1996-03-01", "1997-03-01", closed=False))
    return rows.agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


E1_SQL = f"""
, ranked AS (SELECT corpus_id, term, sum(weight) AS score FROM doc_terms WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL),
main AS (SELECT corpus_id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, term) AS r, count(*) OVER (PARTITION BY corpus_id) AS n FROM ranked)
  WHERE r <= least(5000, round_even(n * 0.75, 0)))
"""


@query("e1_main_list", "SELECT * FROM main", TEXT_SQL + E1_SQL)
def e1(spark, sf_dir):
    ranking = M.occurrences(text_terms(spark, sf_dir)).withColumnRenamed("occurrences", "score")
    return L.main_list(ranking, F.broadcast(stop_list(spark)))


@query(
    "e3_documents_for_terms",
    ", f AS (SELECT doc_id, sum(score) AS score FROM d3 WHERE term IN ('thing', 'tion', 'ed', 'the') AND corpus_id = 'src3' GROUP BY 1) SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM f) AS total FROM f ORDER BY f.score DESC, doc_id LIMIT 5",
    TEXT_SQL + D3_SQL.format(rows="doc_terms", groups=NO_GROUPS, where="true"),
)
def e3(spark, sf_dir):
    wanted = spark.createDataFrame([("thing",), ("tion",), ("ed",), ("the",)], "term string")
    scores = M.tfidf_documents(text_terms(spark, sf_dir).where("corpus_id = 'src3'"), F.broadcast(wanted))
    return L.documents_for_terms(scores, wanted).withColumn("score", six("score"))


@query(
    "e4_paged_list",
    f"""SELECT term, occurrences AS score FROM (SELECT term FROM {NAMES} UNION SELECT subform FROM groups) LEFT JOIN
    (SELECT term, sum(weight) AS occurrences FROM basket WHERE corpus_id = 'NATION_3' AND weight > 10 GROUP BY 1) USING (term) ORDER BY score DESC NULLS FIRST, term LIMIT 20 OFFSET 10""",
    BASKET_SQL,
)
def e4(spark, sf_dir):
    occ = M.occurrences(baskets(spark, sf_dir).where("corpus_id = 'NATION_3' AND weight > 10"), by=()).withColumnRenamed("occurrences", "score")
    return L.paged_list(basket_list(spark, sf_dir), occ, basket_groups(spark, sf_dir), 20, 10)


@query("e5_paged_documents", "SELECT doc_id, pub_date::TIMESTAMP AS pub_ts, (SELECT count(*) FROM docs WHERE corpus_id = 'src4') AS total FROM docs WHERE corpus_id = 'src4' ORDER BY pub_date, doc_id LIMIT 15 OFFSET 5", TEXT_SQL)
def e5(spark, sf_dir):
    docs = text_documents(spark, sf_dir).where("corpus_id = 'src4'").select("doc_id", F.col("pub_date").cast("timestamp").alias("pub_ts"))
    return docs.orderBy("pub_ts", "doc_id").offset(5).limit(15).crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))


@query("e6_duplicate_documents", "SELECT doc_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept FROM docs WINDOW w AS (PARTITION BY title, lang, length(abstract))", TEXT_SQL)
def e6(spark, sf_dir):
    docs = text_documents(spark, sf_dir).withColumn("n", F.length("abstract"))
    return L.duplicate_documents(docs, "title", "lang", "n")


@query(
    "e8_new_terms",
    """, w AS (SELECT year(pub_date) AS slice, term, sum(weight) AS n FROM basket GROUP BY ALL), everything AS (SELECT term, sum(n) AS n FROM w GROUP BY 1),
    tops AS (SELECT slice, term FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY n DESC, term) AS r, count(*) OVER (PARTITION BY slice) AS m FROM w) WHERE r <= round_even(m * 10 / 100, 0)),
    common AS (SELECT term FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS r, count(*) OVER () AS m FROM everything) WHERE r <= round_even(m * 8 / 100, 0))
    SELECT min(slice) AS slice, term FROM tops WHERE term NOT IN (SELECT term FROM common) GROUP BY term""",
    BASKET_SQL,
)
def e8(spark, sf_dir):
    rows = baskets(spark, sf_dir).withColumn("slice", F.year("pub_date").cast("long"))
    each = checkpointed(rows.groupBy("slice", "term").agg(F.sum("weight").alias("frequency")))
    whole = each.groupBy("term").agg(F.sum("frequency").alias("frequency"))
    special = L.difference(M.top_part_by(each, 10, "slice"), M.top_part(whole, 8))
    return L.new_terms(special)


F1_SQL = "(" + "|".join(L.STOP_STARTS) + ")"


@query("f1_stop_terms", f"SELECT DISTINCT term FROM doc_terms WHERE term IN ({STOP_SQL}) OR regexp_matches(term, '^{F1_SQL}')", TEXT_SQL)
def f1(spark, sf_dir):
    return L.stop_terms(text_terms(spark, sf_dir), stop_list(spark))


G1_SQL = f"""
, freq AS (SELECT term, sum(weight) AS f FROM doc_terms WHERE term NOT IN ({STOP_SQL}) GROUP BY 1),
keyed AS (SELECT *, CASE WHEN length(term) <= 3 THEN term WHEN regexp_matches(term, '(^|[^ea])ies$') THEN regexp_replace(term, 'ies$', 'y')
  WHEN regexp_matches(term, '(^|[^aeo])es$') THEN regexp_replace(term, 'es$', 'e') WHEN regexp_matches(term, '(^|[^us])s$') THEN regexp_replace(term, 's$', '') ELSE term END AS key
  FROM freq WHERE NOT regexp_matches(term, '[^\\p{{L}}\\p{{N}}_]')),
led AS (SELECT *, first_value(term) OVER (PARTITION BY key ORDER BY f DESC, term) AS mainform FROM keyed)
"""


@query("g1_group_by_stem", "SELECT mainform, term AS subform FROM led WHERE term <> mainform", TEXT_SQL + G1_SQL)
def g1(spark, sf_dir):
    rows = text_terms(spark, sf_dir).where(~F.col("term").rlike(r"[^\p{L}\p{N}_]"))
    return L.group_by_stem(rows, F.broadcast(stop_list(spark)), T.stem_key)


@query(
    "g1_group_by_language",
    f""", freq AS (SELECT lang, term, sum(weight) AS f FROM doc_terms JOIN docs USING (doc_id) WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL),
    led AS (SELECT lang, term, first_value(term) OVER (PARTITION BY lang, key ORDER BY f DESC, term) AS mainform FROM (SELECT *, {LANGUAGE_KEY_SQL} AS key FROM freq))
    SELECT lang, mainform, term AS subform FROM led WHERE term <> mainform""",
    TEXT_SQL,
)
def g1_language(spark, sf_dir):
    return L.group_by_stem(text_terms(spark, sf_dir, "lang"), stop_list(spark), T.language_key, lang="lang")


@query(
    "g2_group_union",
    """, firsts AS (SELECT min(p_name) OVER (PARTITION BY split_part(p_name, ' ', 1)) AS mainform, p_name AS subform FROM (SELECT DISTINCT p_name FROM part)),
    links AS (SELECT * FROM groups UNION ALL SELECT * FROM firsts WHERE mainform <> subform),
    both_ AS (SELECT mainform AS v, subform AS w FROM links UNION SELECT subform, mainform FROM links),
    reach AS (SELECT v, v AS w FROM both_ UNION SELECT r.v, e.w FROM reach r JOIN both_ e ON r.w = e.v),
    part_ AS (SELECT v, min(w) AS label FROM reach GROUP BY 1),
    led AS (SELECT v, first_value(v) OVER (PARTITION BY label ORDER BY (SELECT count(*) FROM links WHERE mainform = v) DESC, v) AS mainform FROM part_)
    SELECT mainform, v AS subform FROM led WHERE v <> mainform""",
    "RECURSIVE " + BASKET_SQL,
)
def g2(spark, sf_dir):
    groups = basket_groups(spark, sf_dir)
    firsts = basket_list(spark, sf_dir).withColumn("key", F.split_part("term", F.lit(" "), F.lit(1)))
    low = firsts.groupBy("key").agg(F.min("term").alias("mainform"))
    other = firsts.join(low, "key").where("term <> mainform").select("mainform", F.col("term").alias("subform"))
    return L.group_union(groups, other)


@query("g3_group_listing", "SELECT mainform, subform, (SELECT count(*) FROM groups h WHERE h.mainform = g.mainform) AS size FROM groups g", BASKET_SQL)
def g3(spark, sf_dir):
    groups = basket_groups(spark, sf_dir)
    return groups.join(groups.groupBy("mainform").agg(F.count("*").alias("size")), "mainform").select("mainform", "subform", "size").orderBy("mainform", "subform")


@query(
    "g4_change_links",
    "SELECT mainform, subform FROM groups WHERE subform NOT LIKE 's%' UNION SELECT 'anything', term FROM (SELECT DISTINCT p_type AS term FROM part)",
    BASKET_SQL,
)
def g4(spark, sf_dir):
    groups = basket_groups(spark, sf_dir)
    new = table(spark, sf_dir, "part").select(F.lit("anything").alias("mainform"), F.col("p_type").alias("subform"))
    return L.remove_links(L.add_links(groups, new), groups.where("subform LIKE 's%'"))


@query("g5_main_form", f"SELECT term, coalesce(mainform, term) AS mainform FROM {NAMES} LEFT JOIN groups ON term = subform", BASKET_SQL)
def g5(spark, sf_dir):
    return L.main_form(basket_groups(spark, sf_dir), basket_list(spark, sf_dir))


# ---- algebra: A holds terms of one nation's baskets, B of another's, M the pairs of names and brands in one order

ALGEBRA_SQL = """
, ua AS (SELECT DISTINCT term FROM basket WHERE corpus_id = 'NATION_7' AND weight >= 40), ub AS (SELECT DISTINCT term FROM basket WHERE corpus_id = 'NATION_3' AND weight <= 5 AND pub_date < DATE '1997-01-01'),
wa AS (SELECT term, sum(weight) AS weight FROM basket WHERE corpus_id = 'NATION_7' AND weight >= 40 GROUP BY 1), wb AS (SELECT term, sum(weight) AS weight FROM basket WHERE corpus_id = 'NATION_3' AND weight <= 5 AND pub_date < DATE '1997-01-01' GROUP BY 1),
m AS (SELECT a.term AS a, b.term AS b, CAST(count(*) AS DOUBLE) AS weight FROM basket a JOIN basket b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL),
n AS (SELECT a.term AS a, b.term AS b, CAST(count(*) AS DOUBLE) AS weight FROM basket a JOIN basket b ON a.doc_id = b.doc_id AND a.term < b.term WHERE a.weight > 20 GROUP BY ALL)
"""


def operands(spark, sf_dir):
    rows = baskets(spark, sf_dir)
    a, b = rows.where("corpus_id = 'NATION_7' AND weight >= 40"), rows.where("corpus_id = 'NATION_3' AND weight <= 5 AND pub_date < DATE '1997-01-01'")
    wa, wb = (x.groupBy("term").agg(F.sum("weight").alias("weight")) for x in (a, b))
    return wa.select("term"), wb.select("term"), wa, wb


def matrices(spark, sf_dir):
    """Counts of the pairs in each order, made where the order's terms are: they become one row, and no two sets of rows are joined."""
    rows = baskets(spark, sf_dir).where("doc_id is not null")
    docs = rows.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("term").alias("a"), F.col("weight").alias("w"))).alias("terms"))
    pairs = docs.select("terms", F.explode("terms").alias("x")).select("x.a", "x.w", F.explode("terms.a").alias("b")).where("a < b")
    count = lambda df: df.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    return count(pairs), count(pairs.where("w > 20"))


def algebra(name, sql):
    return query(name, sql, BASKET_SQL + ALGEBRA_SQL)


@algebra("i1_union", "SELECT term FROM ua UNION SELECT term FROM ub")
def i1(spark, sf_dir):
    a, b, *_ = operands(spark, sf_dir)
    return L.union(a, b)


@algebra("i2_difference", "SELECT term FROM ua EXCEPT SELECT term FROM ub")
def i2(spark, sf_dir):
    a, b, *_ = operands(spark, sf_dir)
    return L.difference(a, b)


@algebra("i3_intersection", "SELECT term FROM ua INTERSECT SELECT term FROM wb")
def i3(spark, sf_dir):
    a, _, _, wb = operands(spark, sf_dir)
    return L.intersection(a, wb)


@algebra("i4_set_times_weighted", "SELECT term, weight FROM wb JOIN ua USING (term)")
def i4(spark, sf_dir):
    a, _, _, wb = operands(spark, sf_dir)
    return L.times(a, wb)


@algebra("i5_plus", "SELECT term, sum(weight) AS weight FROM (FROM wa UNION ALL FROM wb) GROUP BY 1")
def i5(spark, sf_dir):
    *_, wa, wb = operands(spark, sf_dir)
    return L.plus(wa, wb)


@algebra("i6_minus", "SELECT term, sum(weight) AS weight FROM (FROM wa UNION ALL SELECT term, -weight FROM wb) GROUP BY 1 HAVING sum(weight) <> 0")
def i6(spark, sf_dir):
    *_, wa, wb = operands(spark, sf_dir)
    return L.minus(wa, wb)


@algebra("i7_times", "SELECT term, wa.weight * wb.weight AS weight FROM wa JOIN wb USING (term)")
def i7(spark, sf_dir):
    *_, wa, wb = operands(spark, sf_dir)
    return L.times(wa, wb)


@algebra("i8_translate", "SELECT coalesce(mainform, term) AS term, sum(weight) AS weight FROM wa LEFT JOIN groups ON term = subform GROUP BY 1")
def i8(spark, sf_dir):
    return L.translate(operands(spark, sf_dir)[2], basket_groups(spark, sf_dir))


@algebra(
    "i9_compose",
    """, t AS (SELECT term AS mainform, 'all ' || split_part(term, ' ', 2) AS target FROM (SELECT DISTINCT mainform AS term FROM groups)),
    both_ AS (SELECT target AS mainform, mainform AS subform FROM t UNION ALL SELECT mainform, subform FROM groups WHERE subform NOT IN (SELECT mainform FROM t))
    SELECT coalesce(o.mainform, b.mainform) AS mainform, b.subform FROM both_ b LEFT JOIN both_ o ON o.subform = b.mainform WHERE coalesce(o.mainform, b.mainform) <> b.subform""",
)
def i9(spark, sf_dir):
    groups = basket_groups(spark, sf_dir)
    further = groups.select(F.col("mainform").alias("subform")).distinct().withColumn("mainform", F.concat(F.lit("all "), F.split_part("subform", F.lit(" "), F.lit(2))))
    return L.compose(groups, further.select("mainform", "subform"))


@algebra("i10_matrix_minus", "SELECT m.a, m.b, m.weight - coalesce(n.weight, 0) AS weight FROM m LEFT JOIN n ON m.a = n.a AND m.b = n.b WHERE m.weight <> coalesce(n.weight, 0)")
def i10(spark, sf_dir):
    m, n = matrices(spark, sf_dir)
    return L.matrix_plus(m, n, sign=-1)


@algebra("i11_matrix_without", "SELECT * FROM m WHERE a NOT IN (SELECT term FROM ub) AND b NOT IN (SELECT term FROM ub)")
def i11(spark, sf_dir):
    return L.matrix_without(matrices(spark, sf_dir)[0], operands(spark, sf_dir)[1])


@algebra("i11_matrix_inside", "SELECT * FROM m WHERE a IN (SELECT term FROM ua) AND b IN (SELECT term FROM ua)")
def i11_inside(spark, sf_dir):
    return L.matrix_inside(matrices(spark, sf_dir)[0], operands(spark, sf_dir)[0])


@algebra("i12_matrix_translate", "SELECT a, coalesce(mainform, b) AS b, sum(weight) AS weight FROM m LEFT JOIN groups ON b = subform GROUP BY ALL")
def i12(spark, sf_dir):
    return L.matrix_translate(matrices(spark, sf_dir)[0], basket_groups(spark, sf_dir))


@algebra("i13_matrix_over", "SELECT a, b, round(m.weight / sqrt(x.weight * y.weight), 6) AS weight FROM m JOIN wa x ON a = x.term JOIN wa y ON b = y.term")
def i13(spark, sf_dir):
    return L.matrix_scale(matrices(spark, sf_dir)[0], operands(spark, sf_dir)[2], divide=True).withColumn("weight", six("weight"))


# ---- life cycle

LISTS_SQL = f"""
, old AS (SELECT 'main' AS list_name, term FROM {NAMES} UNION ALL SELECT 'stop', term FROM {KINDS}),
fresh AS (SELECT 'map' AS list_name, mainform AS term FROM groups WHERE mainform < 'h' GROUP BY 2 UNION ALL SELECT 'main', term FROM {KINDS} WHERE term LIKE 'Brand%'),
best AS (SELECT term, max(CASE list_name WHEN 'map' THEN 3 WHEN 'main' THEN 2 ELSE 1 END) AS rank FROM (FROM old UNION ALL FROM fresh) GROUP BY 1),
ruled AS (SELECT coalesce(b.term, s.subform) AS term, coalesce(s.led, b.rank) AS rank FROM best b FULL JOIN
  (SELECT subform, max(rank) AS led FROM groups JOIN best ON term = mainform GROUP BY 1) s ON b.term = s.subform),
merged AS (SELECT 'map' AS list_name, term FROM ruled WHERE rank = 3 UNION ALL SELECT 'main', term FROM ruled WHERE rank >= 2 UNION ALL SELECT 'stop', term FROM ruled WHERE rank = 1)
"""


def merged(spark, sf_dir):
    names, kinds, groups = basket_list(spark, sf_dir), basket_list(spark, sf_dir, "kind"), basket_groups(spark, sf_dir)
    label = lambda df, name: df.select(F.lit(name).alias("list_name"), "term")
    fresh = label(groups.where("mainform < 'h'").select(F.col("mainform").alias("term")).distinct(), "map").unionByName(label(kinds.where("term LIKE 'Brand%'"), "main"))
    return L.merge_lists(label(names, "main").unionByName(label(kinds, "stop")), fresh, groups), groups


@query("j1_merge_lists", "SELECT * FROM merged", BASKET_SQL + LISTS_SQL)
def j1(spark, sf_dir):
    return merged(spark, sf_dir)[0]


@query("j3_merge_chosen", "SELECT list_name, term FROM merged WHERE list_name IN ('map', 'main')", BASKET_SQL + LISTS_SQL)
def j3(spark, sf_dir):
    return merged(spark, sf_dir)[0].where("list_name IN ('map', 'main')")


CLEAN = lambda c: T.normalise_term(T.normalise_chars(c))


@query(
    "j2_import_merge",
    r"""WITH given AS (SELECT DISTINCT lang AS label, 'main' AS status FROM documents UNION ALL SELECT 'of the', 'map'), looked AS (SELECT lower(label) AS term FROM given UNION SELECT 'in the'),
    old AS (SELECT 'stop' AS list_name, lang AS term FROM documents GROUP BY 2), fresh AS (SELECT 'main' AS list_name, term FROM looked UNION ALL SELECT 'map', 'of the' UNION ALL SELECT 'map', 'in the'),
    best AS (SELECT term, max(CASE list_name WHEN 'map' THEN 3 WHEN 'main' THEN 2 ELSE 1 END) AS rank FROM (FROM old UNION ALL FROM fresh) GROUP BY 1)
    SELECT 'map' AS list_name, term FROM best WHERE rank = 3 UNION ALL SELECT 'main', term FROM best WHERE rank >= 2 UNION ALL SELECT 'stop', term FROM best WHERE rank = 1""",
)
def j2(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    labels = docs.select(F.col("lang").alias("label"), F.lit("main").alias("status"), F.lit("").alias("forms")).distinct()
    given = labels.unionByName(spark.createDataFrame([("of the", "map", "in the")], "label string, status string, forms string"))
    old = docs.select(F.lit("stop").alias("list_name"), F.col("lang").alias("term")).distinct()
    none = spark.createDataFrame([], "mainform string, subform string")
    return L.import_and_merge(given, CLEAN, old, none, docs, F.col("abstract"), text_terms(spark, sf_dir))[0]


@query("j2_import_index", r""", t AS (SELECT doc_id, lower(abstract) AS w FROM docs), g AS (SELECT doc_id, regexp_extract_all(w, '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*') AS w FROM t),
    r AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM g WHERE len(w) > 1)
    SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS weight FROM r WHERE term IN ('of the', 'in the') GROUP BY ALL""", TEXT_SQL)
def j2_index(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    given = spark.createDataFrame([("of the", "map", "in the")], "label string, status string, forms string")
    none = spark.createDataFrame([], "mainform string, subform string")
    lists = spark.createDataFrame([], "list_name string, term string")
    return L.import_and_merge(given, CLEAN, lists, none, docs, F.col("abstract"), text_terms(spark, sf_dir), overwrite=True)[2]


@query(
    "j11_add_term",
    """, given AS (SELECT unnest(['the', 'and', 'zzz unknown']) AS term), c AS (SELECT term, count(DISTINCT doc_id) AS n, sum(weight) AS w FROM doc_terms GROUP BY 1)
    SELECT term, term NOT IN (SELECT term FROM doc_terms) AS is_new, coalesce(n, 0) AS n_docs, coalesce(w, 0) AS occurrences, CASE term WHEN 'and' THEN 'also' ELSE term END AS mainform FROM given LEFT JOIN c USING (term)""",
    TEXT_SQL,
)
def j11(spark, sf_dir):
    raw = spark.createDataFrame([(" The ",), ("'and'",), ("ZZZ  unknown",), ("the",)], "term string")
    groups = spark.createDataFrame([("also", "and")], "mainform string, subform string")
    return L.add_term(raw, CLEAN, text_terms(spark, sf_dir).select("term"), groups, text_documents(spark, sf_dir), F.col("abstract"))


@query("j4_change_members", f"SELECT term FROM {NAMES} WHERE term >= 'm' UNION SELECT term FROM {KINDS}", BASKET_SQL)
def j4(spark, sf_dir):
    names = basket_list(spark, sf_dir)
    return L.union(L.difference(names, names.where("term < 'm'")), basket_list(spark, sf_dir, "kind"))


@query(
    "j5_list_family",
    """SELECT DISTINCT f.term, f.term IN (SELECT term FROM merged WHERE list_name = 'map') AS in_map, f.term IN (SELECT term FROM merged WHERE list_name = 'stop') AS in_stop, subforms
    FROM (SELECT term FROM merged WHERE list_name IN ('main', 'stop') UNION SELECT subform FROM groups) f LEFT JOIN (SELECT mainform AS term, string_agg(DISTINCT subform, '|' ORDER BY subform) AS subforms FROM groups GROUP BY 1) USING (term)""",
    BASKET_SQL + LISTS_SQL,
)
def j5(spark, sf_dir):
    lists, groups = merged(spark, sf_dir)
    pick = lambda name: lists.where(F.col("list_name") == name).select("term")
    return L.list_family(pick("main"), pick("map"), pick("stop"), groups)


@query("j6_map_glance", "SELECT term, sum(weight) AS score FROM merged LEFT JOIN basket USING (term) WHERE list_name = 'map' GROUP BY 1", BASKET_SQL + LISTS_SQL)
def j6(spark, sf_dir):
    occ = M.occurrences(baskets(spark, sf_dir), by=()).withColumnRenamed("occurrences", "score")
    return L.with_scores(merged(spark, sf_dir)[0].where("list_name = 'map'").select("term"), occ)


@query(
    "j7_corpus_list",
    """, bare AS (SELECT list_name, term FROM merged WHERE list_name IN ('map', 'main') AND term NOT IN (SELECT subform FROM groups)),
    full_ AS (SELECT * FROM bare UNION SELECT list_name, subform FROM bare JOIN groups ON term = mainform)
    SELECT * FROM full_ WHERE list_name = 'map' OR term NOT IN (SELECT term FROM full_ WHERE list_name = 'map')""",
    BASKET_SQL + LISTS_SQL,
)
def j7(spark, sf_dir):
    lists, groups = merged(spark, sf_dir)
    return L.corpus_list(lists, ("map", "main"), groups, synonyms=True)


@query("j8_favorites", "SELECT doc_id FROM documents WHERE source = 'src1' AND lang IN ('fr', 'es')")
def j8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source = 'src1'")
    return L.add_favorites(docs.where("lang = 'fr'").select("doc_id"), docs.where("lang IN ('es', 'fr')").select("doc_id"), docs.select("doc_id"))


@query("j8_favorites_refused", "SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'fr'")
def j8_refused(spark, sf_dir):
    """One of the wanted documents is not in the corpus, so none is added."""
    every = table(spark, sf_dir, "documents")
    docs = every.where("source = 'src1'")
    wanted = docs.where("lang = 'es'").select("doc_id").unionByName(every.where("source = 'src2'").select("doc_id").limit(1))
    return L.add_favorites(docs.where("lang = 'fr'").select("doc_id"), wanted, docs.select("doc_id"))


@query("j9_delete_matching", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])idiot($|[^\p{L}\p{N}_])')")
def j9(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    return docs.where(~T.mentions("idiot", F.col("title"), F.col("abstract"))).select("doc_id")


@query(
    "j10_majority_language",
    ", n AS (SELECT corpus_id, lang, count(*) AS n FROM docs GROUP BY ALL), top AS (SELECT corpus_id, lang FROM n QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY n DESC, lang) = 1) SELECT doc_id FROM docs JOIN top USING (corpus_id, lang)",
    TEXT_SQL,
)
def j10(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    counts = docs.where("lang is not null").groupBy("corpus_id", "lang").agg(F.count("*").alias("n"))
    top = counts.groupBy("corpus_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("best")).select("corpus_id", F.col("best.lang").alias("lang"))
    return docs.join(F.broadcast(top), ["corpus_id", "lang"], "left_semi").select("doc_id")

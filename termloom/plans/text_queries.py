"""Queries over texts: normalisation, tokens, phrases, searches and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import documents as D
from termloom.operators import metrics as M
from termloom.operators import search as S
from termloom.operators.storage import scratch

from .base import ORACLES, query
from .corpora import LANGUAGE_KEY_SQL, TEXT_SQL, basket_list, table, text_documents, text_terms
from .list_queries import stop_list
from .term_queries import STOP_SQL

WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
#: Frequent words that tell the languages apart.
PROFILE = {"en": ("the", "of", "and", "is", "with"), "fr": ("le", "les", "et", "une", "dans"), "de": ("der", "die", "und", "ist", "mit"), "es": ("el", "los", "y", "una", "con")}
PROFILE_SQL = "(VALUES " + ", ".join(f"('{lang}', '{w}')" for lang, words in PROFILE.items() for w in words) + ") AS profile(lang, word)"


def b1_sql(column: str) -> str:
    sql = f"trim(regexp_replace(regexp_replace({column}, '[\\x00-\\x1F\\x7F\\x{{2028}}\\x{{2029}}\\x{{92}}\\x{{A0}}\\x{{1680}}\\x{{180E}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]', ' ', 'g'), ' +', ' ', 'g'))"
    for pattern, plain in (("[\\x{2010}-\\x{2015}\\x{2212}\\x{FE63}\\x{AF}]", "-"), ("[\\x{2018}-\\x{201B}`]|\\x{2039} ?| ?\\x{203A}", "''"), ("[\\x{201C}-\\x{201F}]|\\x{AB} ?| ?\\x{BB}", '"'), ("''''", '"'), ("\\x{2026}|\\x{85}", "..."), ("\\x{20AC}", "EUR"), ("[\\x{25AA}\\x{25BA}\\x{25CF}\\x{25D8}\\x{2192}\\x{2022}\\x{B7}]", "*")):
        sql = f"regexp_replace({sql}, '{pattern}', '{plain}', 'g')"
    for joined, letters in T.LIGATURES.items():
        sql = f"replace({sql}, chr({ord(joined)}), '{letters}')"
    return sql


@query("b1_normalise_chars", f"SELECT doc_id, {b1_sql('text')} AS text FROM documents")
def b1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_chars(F.col("text")).alias("text"))


@query("b2_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]{0,45}>', '', 'g') AS text FROM pages")
def b2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


EDGE_SQL = """[-''",;/%(){}\\\\\\[\\]. ©]+"""


@query("b3_normalise_term", f"SELECT doc_id, pos, lower(regexp_replace(regexp_replace(w, '^{EDGE_SQL}', ''), '{EDGE_SQL}$', '')) AS term FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)")
def b3(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalise_term(F.col("w")).alias("term"))


@query("b4_tokens", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents)")
def b4(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


B5_SQL = f"""
l AS (SELECT doc_id, t, array_to_string(list_transform(t, lambda w: CASE WHEN regexp_matches(w, '\\d') THEN 'x' WHEN length(w) <= 4 THEN 'J' ELSE 'N' END), '') AS letters
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)),
r AS (SELECT doc_id, unnest(regexp_extract_all(letters, 'J*N+J*')) AS run, unnest(string_split_regex(letters, 'J*N+J*')[1:-2]) AS gap, unnest(generate_series(1, len(regexp_extract_all(letters, 'J*N+J*')))) AS i FROM l),
placed AS (SELECT doc_id, length(run) AS n, CAST(sum(length(gap) + length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS last FROM r),
tokens AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(1, len(t))) AS pos FROM l)"""


@query(
    "b5_tagged_chunks",
    """SELECT k.doc_id, string_agg(token, ' ' ORDER BY pos) AS term FROM tokens k ASOF JOIN placed p ON k.doc_id = p.doc_id AND k.pos <= p.last
    WHERE pos > last - n AND n <= 6 GROUP BY k.doc_id, last""",
    B5_SQL,
)
def b5(spark, sf_dir):
    """Words of up to four letters stand for adjectives, longer ones for nouns, others for the rest."""
    words = T.tokens(F.lower("text"))
    tag = F.transform(words, lambda w: F.struct(w.alias("token"), F.when(w.rlike(r"\d"), "X").when(F.length(w) <= 4, "JJ").otherwise("NN").alias("tag")))
    rows = table(spark, sf_dir, "documents").select("doc_id", tag.alias("tagged"))
    letter = lambda t: F.when(t == "JJ", "J").when(t == "NN", "N").otherwise("x")
    return rows.select("doc_id", F.explode(T.chunk_tagged(F.col("tagged"), letter)).alias("term"))


PHRASE_SQL = f"""
, w AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(abstract), '{WORD}|[^\\s]') AS t FROM docs)),
c AS (SELECT *, token IN ({STOP_SQL}) OR NOT regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]') AS cut FROM w),
r AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
phrases AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS term FROM r WHERE NOT cut GROUP BY doc_id, run HAVING count(*) <= 6)
"""


@query("b6_phrases", "SELECT doc_id, term, count(*) AS n FROM phrases GROUP BY ALL", TEXT_SQL + PHRASE_SQL)
def b6(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    return D.phrases(docs, F.col("abstract"), stop_list(spark), keys=("doc_id",)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("b8_document_terms", "SELECT doc_id, substr(term, 1, 255) AS term, CAST(count(*) AS DOUBLE) AS weight FROM phrases WHERE length(term) > 1 GROUP BY ALL", TEXT_SQL + PHRASE_SQL)
def b8(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    return D.document_terms(docs, F.col("abstract"), stop_list(spark), keys=("doc_id",))


@query("b8_supported_terms", "SELECT doc_id, substr(term, 1, 255) AS term, CAST(count(*) AS DOUBLE) AS weight FROM phrases JOIN docs USING (doc_id) WHERE lang IN ('en', 'fr', 'de') AND length(term) > 1 GROUP BY ALL", TEXT_SQL + PHRASE_SQL)
def b8_supported(spark, sf_dir):
    """Spanish stands for a language without support."""
    docs = text_documents(spark, sf_dir)
    return D.document_terms(docs, F.col("abstract"), stop_list(spark), F.col("lang"), ("en", "fr", "de"), keys=("doc_id",))


@query(
    "b7_sub_phrases",
    """SELECT p_partkey, array_to_string(list_slice(t, i, j), ' ') AS term
    FROM (SELECT p_partkey, t, i, unnest(generate_series(i, len(t))) AS j FROM (SELECT p_partkey, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)))""",
)
def b7(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.sub_phrases(words)).alias("words")).select("p_partkey", F.array_join("words", " ").alias("term"))


B9_FIELDS = ["lang", "source", "n_chars", "text"]
B9_SQL = """
index_ AS (SELECT doc_id, key, CASE key WHEN 'n_chars' THEN 'int' ELSE CASE WHEN length(value) < 255 THEN 'str' ELSE 'txt' END END AS kind, substr(value, 1, 2712) AS value
  FROM (SELECT doc_id, unnest(['lang', 'source', 'n_chars', 'text']) AS key, unnest([lang, source, CAST(n_chars AS VARCHAR), text]) AS value FROM documents) WHERE value IS NOT NULL)"""


@query("b9_metadata_index", "SELECT doc_id, key, kind, md5(value) AS digest FROM index_", B9_SQL)
def b9(spark, sf_dir):
    rows = D.metadata_index(table(spark, sf_dir, "documents"), "doc_id", B9_FIELDS)
    return rows.select("doc_id", "key", "kind", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(
    "d21_catalogue",
    """SELECT key, kind, CAST(sum(n) AS BIGINT) AS n, md5(min(value)) AS least, md5(max(value)) AS greatest, CASE WHEN count(*) <= 48 THEN string_agg(value, '|' ORDER BY value) END AS known
    FROM (SELECT key, kind, value, count(*) AS n FROM index_ GROUP BY ALL) GROUP BY key, kind""",
    B9_SQL,
)
def d21(spark, sf_dir):
    found = M.catalogue(D.metadata_index(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "n_chars", "text"]))
    hashed = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return found.select("key", "kind", "n", hashed("least"), hashed("greatest"), "known")


@query("b11_count_term", r"SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')) > 0 AS has, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w = 'the')) AS n FROM documents")
def b11(spark, sf_dir):
    n = T.count_term(F.col("text"), "the")
    return table(spark, sf_dir, "documents").select("doc_id", (n > 0).alias("has"), n.cast("long").alias("n"))


@query("b12_field_search", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])of\s+the($|[^\p{L}\p{N}_])')")
def b12(spark, sf_dir):
    return text_documents(spark, sf_dir).where(T.mentions("of  the", F.col("title"), F.col("abstract"))).select("doc_id")


@query(
    "b13_boolean_search",
    f"SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'with') AND (list_contains(t, 'from') OR list_contains(t, 'by')) AND NOT list_contains(t, 'idiot') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')",
)
def b13(spark, sf_dir):
    t = F.col("t")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.lower("text")).alias("t"))
    return rows.where(T.all_of(t, "the", "with") & T.any_of(t, "from", "by") & T.none_of(t, "idiot") & T.phrase(t, "of", "the")).select("doc_id")


@query("b13_indexed_search", ORACLES["b13_boolean_search"])
def b13_indexed(spark, sf_dir):
    path = scratch(spark, "index")
    S.write_index(table(spark, sf_dir, "documents"), F.col("text"), path)
    index = S.Index(spark, path)
    found = index.both(index.both(index.all_of("the", "with"), index.any_of("from", "by")), index.phrase("of", "the"))
    return index.without(found, index.any_of("idiot"))


@query("b14_single_words", "SELECT term, instr(term, ' ') = 0 AS single FROM (SELECT DISTINCT unnest([p_name, p_type]) AS term FROM part)")
def b14(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", "p_type")).alias("term")).distinct()
    return terms.select("term", T.is_single(F.col("term")).alias("single"))


@query("b15_predicates", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_type IN ('PROMO', 'SMALL') AND p_name LIKE '%e%' AND p_name NOT LIKE '%zz%' AND p_brand LIKE 'Brand%'")
def b15(spark, sf_dir):
    c = lambda name, op, value: T.compare(F.col(name), op, value)
    return table(spark, sf_dir, "part").where(c("p_size", ">=", 10) & c("p_size", "!=", 20) & c("p_type", "in", ["PROMO", "SMALL"]) & c("p_name", "contains", "e") & c("p_name", "doesnotcontain", "zz") & c("p_brand", "startswith", "Brand")).select("p_partkey")


@query(
    "b16_document_sizes",
    ", s AS (SELECT doc_id, year(pub_date) AS year, len(t) AS n, len(list_distinct(t)) AS d FROM (SELECT doc_id, pub_date, regexp_extract_all(lower(abstract), '" + WORD + "') AS t FROM docs)) SELECT year, round(avg(n), 6) AS words, round(avg(d), 6) AS distinct_words FROM s GROUP BY 1",
    TEXT_SQL,
)
def b16(spark, sf_dir):
    docs = text_documents(spark, sf_dir)
    sizes = D.document_sizes(docs, F.col("abstract")).join(docs.select("doc_id", F.year("pub_date").cast("long").alias("year")), "doc_id")
    return sizes.groupBy("year").agg(F.round(F.avg("words"), 6).alias("words"), F.round(F.avg("distinct_words"), 6).alias("distinct_words"))


@query(
    "b17_paragraph_language",
    f"""WITH p AS (SELECT doc_id, lang, unnest(x) AS part, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\\n\\s*\\n|\\n') AS x FROM documents)),
    n AS (SELECT doc_id, pos, profile.lang AS found, count(*) AS n FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(part), '{WORD}')) AS word FROM p) JOIN {PROFILE_SQL} USING (word) GROUP BY ALL),
    b AS (SELECT doc_id, pos, found FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, found) = 1)
    SELECT doc_id, count(*) FILTER (WHERE coalesce(found = lang, true)) AS kept, bool_or(NOT coalesce(found = lang, true)) AS cut FROM p LEFT JOIN b USING (doc_id, pos) GROUP BY doc_id""",
)
def b17(spark, sf_dir):
    profile = spark.createDataFrame([(lang, w) for lang, words in PROFILE.items() for w in words], "lang string, word string")
    out = D.paragraphs_in(table(spark, sf_dir, "documents"), F.col("text"), F.col("lang"), profile)
    return out.select("doc_id", F.col("kept_n").cast("long").alias("kept"), "cut")


@query("b17_kept_paragraphs", ORACLES["b17_paragraph_language"].replace("count(*) FILTER (WHERE coalesce(found = lang, true)) AS kept", "md5(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE coalesce(found = lang, true)), '')) AS kept").replace("FROM documents)", "FROM documents WHERE lang IS NOT NULL)"))
def b17_kept(spark, sf_dir):
    profile = spark.createDataFrame([(lang, w) for lang, words in PROFILE.items() for w in words], "lang string, word string")
    out = D.paragraphs_in(table(spark, sf_dir, "documents").where("lang is not null"), F.col("text"), F.col("lang"), profile)
    return out.select("doc_id", F.md5(F.col("kept").cast("binary")).alias("kept"), "cut")


@query(
    "c3_late_terms",
    f""", t AS (SELECT doc_id, regexp_extract_all(lower(abstract), '{WORD}') AS w FROM docs), s AS (SELECT doc_id, w, unnest([1, 2]) AS n FROM t),
    r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM s WHERE len(w) >= n)
    SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS weight FROM r WHERE term IN ('of the', 'in the', 'de la', 'the') AND NOT (term = 'the' AND doc_id < 500) GROUP BY ALL""",
    TEXT_SQL,
)
def c3(spark, sf_dir):
    new = spark.createDataFrame([("of the",), ("in the",), ("de la",), ("the",)], "term string")
    docs = text_documents(spark, sf_dir)
    known = docs.where("doc_id < 500").select("doc_id", F.lit("the").alias("term"))
    return D.index_terms(docs, F.col("abstract"), F.broadcast(new), known, longest=2)


STEM_KEY_SQL = r"""array_to_string(list_transform(list_filter(string_split_regex(term, '[^\p{L}\p{N}_]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 3 THEN w
    WHEN regexp_matches(w, '(^|[^ea])ies$') THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(^|[^aeo])es$') THEN left(w, length(w) - 2) || 'e' WHEN regexp_matches(w, '(^|[^us])s$') THEN left(w, length(w) - 1) ELSE w END), ' ')"""


@query("b10_stem_key", f"SELECT term, {STEM_KEY_SQL} AS key FROM (SELECT DISTINCT p_name AS term FROM part)")
def b10(spark, sf_dir):
    return basket_list(spark, sf_dir).select("term", T.stem_key(F.col("term")).alias("key"))


@query("b10_stem_languages", f"SELECT DISTINCT lang, term, {LANGUAGE_KEY_SQL} AS key FROM doc_terms JOIN docs USING (doc_id)", TEXT_SQL)
def b10_languages(spark, sf_dir):
    words = text_terms(spark, sf_dir, "lang").select("lang", "term").distinct()
    return words.select("lang", "term", T.language_key(F.col("term"), F.col("lang")).alias("key"))


@query("a12_language_profile", "SELECT source AS corpus_id, (SELECT lang FROM documents d WHERE d.source = o.source AND lang IN ('en', 'fr') GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1) AS main_lang, count(*) AS n_docs, coalesce(string_agg(DISTINCT lang, '|' ORDER BY lang) FILTER (WHERE lang NOT IN ('en', 'fr')), '') AS unsupported FROM documents o GROUP BY source")
def a12(spark, sf_dir):
    return D.language_profile(text_documents(spark, sf_dir), F.col("lang"), ("en", "fr"))


@query("a14_sample_by_year", ", k AS (SELECT year(pub_date) AS year, count(*) AS k FROM docs GROUP BY 1) SELECT year, CAST(greatest(1, round_even(100 * k / (SELECT count(*) FROM docs), 0)) AS BIGINT) AS n FROM k", TEXT_SQL)
def a14(spark, sf_dir):
    return D.sample_by_year(text_documents(spark, sf_dir), F.year("pub_date").cast("long"), 100).groupBy("year").agg(F.count("*").alias("n"))


#: DuckDB has no crc32: it is reduced from the bits of the letters of a number.
CRC_SQL = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


@query(
    "a14_sampled_documents",
    f""", y AS (SELECT doc_id, year(pub_date) AS year, {CRC_SQL} AS h FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY h, doc_id) AS place, count(*) OVER (PARTITION BY year) AS k, count(*) OVER () AS n FROM y)
    SELECT doc_id, year FROM r WHERE place <= greatest(1, round_even(300 * k / n, 0))""",
    TEXT_SQL,
)
def a14_documents(spark, sf_dir):
    return D.sample_by_year(text_documents(spark, sf_dir), F.year("pub_date").cast("long"), 300)

"""Queries that write the supplied documents in a source's format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.storage import replace_partitions, scratch
from termloom.sources import ingest as I

from .base import query
from .corpora import BASKET_SQL, TEXT_SQL, basket_groups, basket_list, table, text_documents, text_terms

ONE_LINE = "regexp_replace(text, '\\s+', ' ', 'g')"


@query("a1_tagged_records", f"SELECT doc_id, source, trim({ONE_LINE}) AS abstract, lang, 'A. One' || chr(10) || 'B. Two' AS authors FROM documents")
def a1(spark, sf_dir):
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    record = F.concat(F.lit("TY  - JOUR\nAU  - A. One\nAU  - B. Two\nDO  - "), F.col("doc_id").cast("string"), F.lit("\nJO  - old\nT2  - "), "source", F.lit("\nLA  - "), "lang", F.lit("\nAB  - "), body, F.lit("\nER  -"))
    path = scratch(spark, "ris")
    table(spark, sf_dir, "documents").select(record.alias("value")).write.text(path)
    return I.read_tagged(spark, path).select(F.col("doi").cast("long").alias("doc_id"), "source", "abstract", "lang", "authors")


BODY_SQL = f"trim({ONE_LINE})"


@query("a1_isi_records", f"SELECT doc_id, 'First part ' || source AS title, source, nullif({BODY_SQL}, '') AS abstract, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'en' END AS lang, 'A. One, B. Two' AS authors, 'MAY 3-5' AS publication_month, '2001' AS publication_year FROM documents")
def a1_isi(spark, sf_dir):
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    lang = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nLA "), "lang")).otherwise(F.lit(""))
    record = F.concat(F.lit("PT J\nAU A. One\n   B. Two\nTI First part\n   "), "source", F.lit("\nSO "), "source", F.lit("\nPD MAY 3-5\nPY 2001\nDI "), F.col("doc_id").cast("string"), lang, F.lit("\nAB "), body, F.lit("\nER\n"))
    path = scratch(spark, "isi")
    table(spark, sf_dir, "documents").select(record.alias("value")).write.text(path)
    return I.read_isi(spark, path).select(F.col("doi").cast("long").alias("doc_id"), "title", "source", "abstract", "lang", "authors", "publication_month", "publication_year")


@query("a1_repec_records", f"SELECT doc_id, source AS title, 'Series' AS source, nullif({BODY_SQL}, '') AS abstract, lang, 'A. One' || chr(10) || 'B. Two' AS authors, '1999' AS publication_year FROM documents")
def a1_repec(spark, sf_dir):
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    record = F.concat(F.lit("TY  - JOUR\nT1  - "), "source", F.lit("\nA1  - A. One\nA1  - B. Two\nJO  - Series\nY1  - 1999///\nUR  - "), F.col("doc_id").cast("string"), F.lit("\nLA  - "), "lang", F.lit("\nN2  - "), body, F.lit("\nER\n"))
    path = scratch(spark, "repec")
    table(spark, sf_dir, "documents").select(record.alias("value")).write.text(path)
    return I.read_repec(spark, path).select(F.col("doi").cast("long").alias("doc_id"), "title", "source", "abstract", "lang", "authors", "publication_year")


DATES_SQL = "SELECT doc_id, CAST(year(pub_date) AS VARCHAR) AS y, lpad(CAST(month(pub_date) AS VARCHAR), 2, '0') AS m, lpad(CAST(day(pub_date) AS VARCHAR), 2, '0') AS d FROM docs"


@query("a2_split_date", ", p AS (" + DATES_SQL + ") SELECT doc_id, y AS publication_year, CASE WHEN doc_id % 3 > 0 THEN m END AS publication_month, CASE WHEN doc_id % 3 > 1 THEN d END AS publication_day FROM p", TEXT_SQL)
def a2(spark, sf_dir):
    py = F.when(F.col("doc_id") % 3 == 0, F.date_format("pub_date", "yyyy//")).when(F.col("doc_id") % 3 == 1, F.date_format("pub_date", "yyyy/MM//")).otherwise(F.date_format("pub_date", "yyyy/MM/dd/"))
    return text_documents(spark, sf_dir).select("doc_id", *I.split_date(py))


@query("a3_clean_date", ", p AS (" + DATES_SQL + ") SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN y WHEN 1 THEN y || ' NOV' WHEN 2 THEN y || ' MAY 3' WHEN 3 THEN y || ' Nov' ELSE '1993' END AS date FROM p", TEXT_SQL)
def a3(spark, sf_dir):
    n = F.col("doc_id") % 5
    pd = F.when(n == 0, F.lit("SPR")).when(n == 1, F.lit("NOV-DEC")).when(n == 2, F.lit("MAY 3-5")).when(n == 3, F.lit("Nov-Dec")).otherwise(F.lit("Spr 1993"))
    return text_documents(spark, sf_dir).select("doc_id", I.clean_date(pd, F.year("pub_date").cast("string")).alias("date"))


@query("a4_articles_xml", ", p AS (" + DATES_SQL + ") SELECT CAST(doc_id AS VARCHAR) AS pmid, corpus_id AS source, 'Ann One, Bob Two' AS authors, lang, date_trunc('month', pub_date)::TIMESTAMP AS pub_ts FROM docs WHERE doc_id % 4 > 0", TEXT_SQL)
def a4(spark, sf_dir):
    author = lambda a, b: f"<Author><ForeName>{a}</ForeName><LastName>{b}</LastName></Author>"
    when = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("<PubDate><Year>"), F.year("pub_date").cast("string"), F.lit("</Year><Month>"), F.date_format("pub_date", "MMM"), F.lit("</Month></PubDate>"))).otherwise(F.lit("<PubDate></PubDate>"))
    record = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><ArticleTitle>T1</ArticleTitle><Journal><Title>"), "corpus_id", F.lit("</Title><JournalIssue>"), when,
        F.lit("</JournalIssue></Journal><AuthorList>" + author("Ann", "One") + author("Bob", "Two") + "</AuthorList><Language>"), "lang", F.lit("</Language></Article></MedlineCitation></PubmedArticle>"),
    )
    path = scratch(spark, "xml")
    text_documents(spark, sf_dir).select(record.alias("value")).write.text(path)
    return I.read_articles_xml(spark, path).select("pmid", "source", "authors", "lang", "pub_ts")


@query(
    "a4_articles_xml_fields",
    """SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE doc_id % 3 WHEN 0 THEN 'Report ' || doc_id ELSE 'Rapport ' || doc_id END AS title,
    CASE WHEN doc_id % 2 = 0 THEN corpus_id || ' first. ' || lang || ' second.' ELSE lang || ' only.' END AS abstract, pub_date::TIMESTAMP AS pub_ts FROM docs""",
    TEXT_SQL,
)
def a4_fields(spark, sf_dir):
    """Titles that are empty with one in the language of the text, abstracts in parts, and dates of the second kind."""
    tag = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name}>"))
    number, n = F.col("doc_id").cast("string"), F.col("doc_id")
    title = F.when(n % 3 == 0, tag("ArticleTitle", F.lit("Report "), number)).otherwise(F.concat(F.lit("<ArticleTitle></ArticleTitle>"), tag("VernacularTitle", F.lit("Rapport "), number)))
    parts = F.when(n % 2 == 0, F.concat(tag("AbstractText", "corpus_id", F.lit(" first.")), tag("AbstractText", "lang", F.lit(" second.")))).otherwise(tag("AbstractText", "lang", F.lit(" only.")))
    date = F.concat(tag("Year", F.year("pub_date").cast("string")), tag("Month", F.date_format("pub_date", "M")), tag("Day", F.date_format("pub_date", "d")))
    journal = tag("Journal", tag("Title", F.lit("J")), tag("JournalIssue", F.lit("<PubDate></PubDate>")))
    record = tag("PubmedArticle", tag("MedlineCitation", tag("PMID", number), tag("Article", title, journal, tag("Abstract", parts), tag("Language", F.lit("eng")), tag("ArticleDate", date))))
    path = scratch(spark, "xml")
    text_documents(spark, sf_dir).select(record.alias("value")).write.text(path)
    return I.read_articles_xml(spark, path).select("pmid", "title", "abstract", "pub_ts")


@query("a5_marc_fields", "SELECT CAST(doc_id AS VARCHAR) AS record, lang || ' text' AS abstract, CAST(year(pub_date) AS VARCHAR) AS publication_date, '10.1/' || doc_id AS doi FROM docs", TEXT_SQL)
def a5_fields(spark, sf_dir):
    field = lambda tag, code, *c: [F.lit(f'<datafield tag="{tag}"><subfield code="{code}">'), *c, F.lit('</subfield><subfield code="z">other</subfield></datafield>')]
    number = F.col("doc_id").cast("string")
    record = F.concat(F.lit('<record><controlfield tag="001">'), number, F.lit("</controlfield>"), *field("520", "a", F.col("lang"), F.lit(" text")), *field("269", "c", F.year("pub_date").cast("string")), *field("024", "a", F.lit("10.1/"), number), F.lit("</record>"))
    path = scratch(spark, "marc")
    text_documents(spark, sf_dir).select(record.alias("value")).write.text(path)
    return I.read_marc(spark, path).select("record", "abstract", "publication_date", "doi")


@query("a5_marc_records", "SELECT CAST(doc_id AS VARCHAR) AS record, source AS title, 'First,Second' AS authors, lang FROM documents")
def a5(spark, sf_dir):
    field = lambda tag, c: [F.lit(f'<datafield tag="{tag}"><subfield code="a">'), c, F.lit("</subfield></datafield>")]
    record = F.concat(F.lit('<record><controlfield tag="001">'), F.col("doc_id").cast("string"), F.lit("</controlfield>"), *field("700", F.lit("Second")), *field("100", F.lit("First")), *field("245", F.col("source")), *field("041", F.col("lang")), F.lit("</record>"))
    path = scratch(spark, "marc")
    table(spark, sf_dir, "documents").select(record.alias("value")).write.text(path)
    return I.read_marc(spark, path).select("record", "title", "authors", "lang")


@query("a6_json_dump", "SELECT min(CAST(doc_id AS VARCHAR)) AS docid, min_by(coalesce(nullif(split_part(text, chr(10), 1), ''), 'NOT FOUND'), CAST(doc_id AS VARCHAR)) AS title, 'NOT FOUND' AS abstract, 'A, B' AS authors, 'u' || (doc_id % 700) AS url FROM documents GROUP BY 5")
def a6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("docid"), F.array(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_s"), F.array().cast("array<string>").alias("abstract_s"),
        F.array(F.lit("A"), F.lit("B")).alias("authFullName_s"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("uri_s"), F.lit("eng").alias("language_s"),
    )
    path = scratch(spark, "json")
    rows.write.json(path)
    out = I.read_hal_json(spark, path, lines=True).select("docid", "title", "abstract", "authors", "url")
    return out


@query(
    "a6_istex_dump",
    f""", p AS ({DATES_SQL}) SELECT CAST(doc_id AS VARCHAR) AS id, title, CASE WHEN doc_id % 2 = 0 THEN corpus_id ELSE 'corpus' END AS source, 'A, B' AS authors, 'd' || doc_id AS doi,
    CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'fr' END AS lang, CASE doc_id % 4 WHEN 1 THEN make_date(CAST(y AS BIGINT), 1, 1) WHEN 2 THEN make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), 1) ELSE make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), CAST(d AS BIGINT)) END::TIMESTAMP AS pub_ts
    FROM docs JOIN p USING (doc_id) WHERE doc_id % 4 > 0""",
    TEXT_SQL,
)
def a6_istex(spark, sf_dir):
    n = F.col("doc_id") % 4
    when = F.when(n == 1, F.date_format("pub_date", "yyyy")).when(n == 2, F.date_format("pub_date", "yyyy-MM")).when(n == 3, F.date_format("pub_date", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    title = F.when(F.col("doc_id") % 2 == 0, F.col("corpus_id"))
    language = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("fre"), F.lit("eng")))
    name = lambda x: F.struct(F.lit(x).alias("name"))
    hit = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("corpus").alias("corpusName"), "title", language.alias("language"), F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("doi"),
        F.struct(title.alias("title")).alias("host"), when.alias("publicationDate"), F.array(name("A"), name("B")).alias("author"),
    )
    path = scratch(spark, "istex")
    text_documents(spark, sf_dir).select(F.array(hit).alias("hits")).write.json(path)
    return I.read_istex_json(spark, path, lines=True).select("id", "title", "source", "authors", "doi", "lang", "pub_ts")


@query(
    "a6_multivac_dump",
    f""", p AS ({DATES_SQL}) SELECT CAST(doc_id AS VARCHAR) AS id, title, abstract, '' AS type, CASE WHEN doc_id % 2 = 0 THEN corpus_id ELSE 'REPEC Database' END AS source, 'A, B' AS authors, 'u' || doc_id AS url,
    make_date(CAST(CASE WHEN doc_id % 3 = 0 THEN '1999' ELSE y END AS BIGINT), 1, 1)::TIMESTAMP AS pub_ts FROM docs JOIN p USING (doc_id)""",
    TEXT_SQL,
)
def a6_multivac(spark, sf_dir):
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    serial = F.struct(F.when(even, F.col("corpus_id")).alias("journaltitle"), F.when(third, F.lit("Invalide date")).otherwise(F.date_format("pub_date", "yyyy")).alias("issuedate"))
    person = lambda x: F.struct(F.struct(F.lit(x).alias("name")).alias("person"))
    source = F.struct(F.col("doc_id").cast("string").alias("id"), "title", "abstract", F.lit("1999").alias("issuedate"), serial.alias("serial"), F.array(person("A"), person("B")).alias("hasauthor"), F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")).alias("file"))
    path = scratch(spark, "multivac")
    text_documents(spark, sf_dir).select(source.alias("_source")).write.json(path)
    return I.read_multivac_json(spark, path, lines=True)


@query("a6_isidore_dump", "SELECT min(title) AS title, 'u' || (doc_id % 500) AS url, CASE WHEN doc_id % 500 % 2 = 0 THEN 'J' ELSE 'ISIDORE Database' END AS source, 'A' AS authors, '' AS abstract, TIMESTAMP '1958-01-01 00:00:00' AS pub_ts FROM docs GROUP BY doc_id % 500", TEXT_SQL)
def a6_isidore(spark, sf_dir):
    n = F.col("doc_id") % 500
    rows = text_documents(spark, sf_dir).select("title", F.lit("A").alias("authors"), F.concat(F.lit("u"), n.cast("string")).alias("url"), F.when(n % 2 == 0, F.lit("J")).alias("source"), F.lit("1958-01-01T00:00:00").alias("date"))
    path = scratch(spark, "isidore")
    rows.write.json(path)
    return I.read_isidore_json(spark, path, lines=True)


@query("a7_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS lang FROM documents")
def a7(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")).write.csv(path, header=True, sep="\t")
    return I.read_csv(spark, path)


@query("a8_press_articles", r"SELECT page_id, len(regexp_extract_all(html, '(?s)<article.*?</article>')) AS n, nullif(regexp_extract(html, '<html[^>]*\blang=\"([^\"]*)\"', 1), '') AS lang FROM pages WHERE regexp_matches(html, '(?s)<article.*?</article>')")
def a8(spark, sf_dir):
    return I.press_articles(table(spark, sf_dir, "pages")).groupBy("page_id", "lang").agg(F.count("*").alias("n"))


BARE = "trim(regexp_replace(regexp_replace({}, '[<>]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "a8_press_documents",
    f""", p AS ({DATES_SQL}), b AS (SELECT doc_id, corpus_id, pub_date, {BARE.format('title')} AS title, {BARE.format('abstract')} AS body FROM docs)
    SELECT doc_id, title, 'A. One; B. Two' AS authors, '<p>' || body || '</p>' || chr(10) || '<p>end</p>' AS abstract, corpus_id AS source, 'no. 7' AS number, CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'en' END AS lang,
    pub_date::TIMESTAMP AS pub_ts, CASE WHEN doc_id % 3 > 0 THEN 'World' END AS section FROM b""",
    TEXT_SQL,
)
def a8_press(spark, sf_dir):
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>]", " "), r"\s+", " "))
    french = F.element_at(F.array(*[F.lit(m) for m in I.MONTHS["fr"]]), F.month("pub_date"))
    date = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", F.lit("lundi"), F.dayofmonth("pub_date"), french, F.year("pub_date"))).otherwise(F.concat(F.lit("Monday, "), F.date_format("pub_date", "MMMM d, yyyy")))
    header = F.concat(F.when(F.col("doc_id") % 3 > 0, F.lit("World, ")).otherwise(F.lit("")), date, F.lit(", p. 9"))
    html = F.concat(
        F.lit('<html><body><article><header><div><span class="DocPublicationName">'), "corpus_id", F.lit(', no. 7</span></div><div><span class="DocHeader">'), header,
        F.lit('</span></div><div class="titreArticle"><p class="titreArticleVisu rdp__articletitle">'), bare("title"), F.lit('</p></div><div class="docAuthors">A. One</div><div class="docAuthors">B. Two</div></header><section><div class="DocText clearfix"><p>'),
        bare("abstract"), F.lit("</p><p>end</p></div></section></article></body></html>"),
    )
    pages = text_documents(spark, sf_dir).select("doc_id", html.alias("html"))
    path = scratch(spark, "press")
    pages.write.parquet(path)
    return I.press_documents(spark.read.parquet(path), key="doc_id").where("error is null").drop("pos", "error")


@query("a9_dates", ", p AS (" + DATES_SQL + ") SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN make_date(CAST(y AS BIGINT), 1, 1) WHEN 1 THEN make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), 1) ELSE make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), CAST(d AS BIGINT)) END::TIMESTAMP AS ts FROM p", TEXT_SQL)
def a9(spark, sf_dir):
    n = F.col("doc_id") % 3
    none = F.lit(None).cast("string")
    y, m, d = (F.date_format("pub_date", f) for f in ("yyyy", "MM", "dd"))
    stamp = I.timestamp_of(F.when(n == 2, F.date_format("pub_date", "yyyy-MM-dd")).otherwise(none), y, F.when(n == 1, m).otherwise(none), none)
    return text_documents(spark, sf_dir).select("doc_id", stamp.alias("ts"))


@query("a10_languages", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'de' WHEN 2 THEN 'nl' ELSE '__unknown__' END AS lang FROM documents")
def a10(spark, sf_dir):
    n = F.col("doc_id") % 4
    given = F.when(n == 0, F.col("lang")).when(n == 1, F.lit("ger")).when(n == 2, F.lit("Dutch")).otherwise(F.lit("xx"))
    return table(spark, sf_dir, "documents").select("doc_id", I.language_code(given).alias("lang"))


@query("a11_first_of", "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def a11(spark, sf_dir):
    return I.first_of(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


@query("a13_bad_records", "SELECT doc_id FROM documents WHERE n_chars >= 100")
def a13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("error", F.when(F.col("n_chars") < 100, F.lit("too short")))
    return I.good(docs).select("doc_id")


@query("a15_new_terms", "SELECT DISTINCT term FROM doc_terms WHERE corpus_id = 'src1' AND term NOT IN (SELECT term FROM doc_terms WHERE corpus_id = 'src2')", TEXT_SQL)
def a15(spark, sf_dir):
    terms = text_terms(spark, sf_dir)
    return I.new_terms(terms.where("corpus_id = 'src1'"), terms.where("corpus_id = 'src2'").select("term").distinct())


@query(
    "a15_dictionary_load",
    """, given AS (SELECT DISTINCT term FROM doc_terms WHERE corpus_id = 'src1'), known AS (SELECT DISTINCT term FROM doc_terms WHERE corpus_id = 'src2'), every AS (SELECT term FROM given UNION SELECT term FROM known)
    SELECT term, 1 AS n, term NOT IN (SELECT term FROM known) AS is_new, (SELECT count(*) FROM given WHERE term NOT IN (SELECT term FROM known)) AS n_new FROM every""",
    TEXT_SQL,
)
def a15_load(spark, sf_dir):
    terms = text_terms(spark, sf_dir)
    loaded = I.load_terms(terms.where("corpus_id = 'src1'"), terms.where("corpus_id = 'src2'").select("term").distinct())
    return loaded.crossJoin(F.broadcast(loaded.agg(F.count_if("is_new").alias("n_new"))))


@query("a16_replace_partitions", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN source = 'src3' THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM documents GROUP BY 1")
def a16(spark, sf_dir):
    path = scratch(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(0).alias("mark"))
    replace_partitions(docs, path, "source")
    replace_partitions(docs.where("source = 'src3'").withColumn("mark", F.lit(1)), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("mark").alias("replaced"))


EXPORT_SQL = """
, g AS (SELECT mainform AS label, string_agg(subform, '|&|' ORDER BY subform) AS forms FROM groups GROUP BY 1),
rows_ AS (SELECT 'map' AS status, p_name AS label FROM (SELECT DISTINCT p_name FROM part WHERE p_name < 'h') UNION ALL SELECT 'main', p_name FROM (SELECT DISTINCT p_name FROM part WHERE p_name >= 'h') UNION ALL SELECT 'stop', p_type FROM (SELECT DISTINCT p_type FROM part))
"""


def exported(spark, sf_dir):
    names = basket_list(spark, sf_dir)
    stop = table(spark, sf_dir, "part").select(F.col("p_type").alias("term")).distinct()
    return I.export_lists(names.where("term < 'h'"), names, stop, basket_groups(spark, sf_dir))


@query("a17_list_export", "SELECT status, label, coalesce(forms, '') AS forms FROM rows_ LEFT JOIN g USING (label) WHERE label NOT IN (SELECT subform FROM groups)", BASKET_SQL + EXPORT_SQL)
def a17(spark, sf_dir):
    return exported(spark, sf_dir)


@query(
    "a18_list_import",
    """, e AS (SELECT status, label, unnest([label] || string_split(coalesce(forms, label), '|&|')) AS term FROM rows_ LEFT JOIN g USING (label) WHERE label NOT IN (SELECT subform FROM groups))
    SELECT DISTINCT status AS list_name, lower(term) AS term FROM e UNION SELECT 'main', lower(term) FROM e WHERE status = 'map'""",
    BASKET_SQL + EXPORT_SQL,
)
def a18(spark, sf_dir):
    path = scratch(spark, "lists")
    exported(spark, sf_dir).write.csv(path, sep="\t", header=True)
    return I.import_lists(I.read_csv(spark, path), lambda c: T.normalise_term(T.normalise_chars(c)))[0]


@query("a19_document_table", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, title, lang, '' AS doi FROM docs", TEXT_SQL)
def a19(spark, sf_dir):
    return I.export_documents(text_documents(spark, sf_dir), ["doc_id", "title", "lang", "doi"])

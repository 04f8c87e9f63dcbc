"""Bulk ingest: a Spark read and a mapping to documents for each format, and the exports.

Records that cannot be mapped stay in, with an ``error``; see ``good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the tagged formats, later tags of a field winning over earlier ones, and how repeated tags join.
RIS_TAGS = {"TI": "title", "T1": "title", "AU": "authors", "JO": "source", "T2": "source", "PY": "publication_date", "UR": "url", "LA": "lang", "AB": "abstract", "DO": "doi"}
RIS_JOINS = {"AU": "\n", "TI": " ", "T1": " ", "AB": " ", "N2": " "}
ISI_TAGS = {"TI": "title", "AU": "authors", "DI": "doi", "SO": "source", "PY": "publication_year", "PD": "publication_month", "LA": "lang", "AB": "abstract", "WC": "fields"}
ISI_JOINS = {"AU": ", ", "TI": " ", "AB": " "}
REPEC_TAGS = {"T1": "title", "ST": "subtitle", "A1": "authors", "JO": "source", "UR": "doi", "Y1": "publication_year", "PD": "publication_month", "N1": "references", "LA": "lang", "N2": "abstract", "WC": "fields"}
REPEC_JOINS = {"T1": " ", "ST": " ", "A1": "\n", "N1": ", ", "N2": " "}


def read_tagged(spark: SparkSession, path: str, tags: dict[str, str] = RIS_TAGS, joins: dict[str, str] = RIS_JOINS, value_from: int = 7, end: str = "ER  -", key: str = "record") -> DataFrame:
    """One row per record of tagged lines (A1): records end at a line that starts with ``end``, which is a whole line where it ends
    with a line feed; a line without a tag continues the one before; repeated tags join; of several tags of a field the last in
    ``tags`` that the record has wins; no language is ``en``. What holds none of the tags, as a file's last line, is no record."""
    lines = spark.read.option("lineSep", f"\n{end}").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), rf"\n{end.strip()[:2]}\s*$", "").alias("value"), F.monotonically_increasing_id().alias(key))
    # Within the row: a line with a tag opens a part, the lines behind it belong to it. U+0001 to U+0003 mark places and are taken out of texts.
    tag = lambda line: F.regexp_extract(line, r"^([A-Z][A-Z0-9])(?:  - |\s|$)", 1)
    opened = lambda line: F.when(tag(line) != "", F.concat(F.lit("\u0002"), tag(line), F.lit("\u0003"), F.substr(line, F.lit(value_from)))).otherwise(line)
    parts = F.split(F.array_join(F.transform(F.split(F.translate("value", "\u0001\u0002\u0003", ""), "\n"), opened), "\u0001"), "\u0002")
    values = lambda p: F.filter(F.transform(F.split(F.substring_index(p, "\u0003", -1), "\u0001"), lambda v: F.trim(v)), lambda v: v != "")
    tagged = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\u0003"))), lambda p: F.struct(F.substring_index(p, "\u0003", 1).alias("tag"), values(p).alias("values")))
    filled = lines.select(key, F.filter(tagged, lambda x: F.size(x["values"]) > 0).alias("lines")).where(F.exists("lines", lambda x: x["tag"].isin(*tags)))
    field = lambda t: F.array_join(F.flatten(F.transform(F.filter("lines", lambda x: x["tag"] == t), lambda x: x["values"])), joins.get(t, " "))
    out = {}
    for t, name in tags.items():
        found = F.nullif(field(t), F.lit(""))
        out[name] = F.coalesce(found, out[name]) if name in out else found
    out["lang"] = F.coalesce(out["lang"], F.lit("en"))
    return filled.select(key, *[c.alias(name) for name, c in out.items()])


def read_isi(spark: SparkSession, path: str) -> DataFrame:
    """Web of Science records (A1): values from column 3, a record ends at a line ER."""
    return read_tagged(spark, path, ISI_TAGS, ISI_JOINS, value_from=4, end="ER\n")


def read_repec(spark: SparkSession, path: str, end: str = "ER\n") -> DataFrame:
    """RePEc records (A1): the year is the first four characters of its tag."""
    rows = read_tagged(spark, path, REPEC_TAGS, REPEC_JOINS, end=end)
    return rows.withColumn("publication_year", F.substring("publication_year", 1, 4))


def split_date(py: Column) -> list[Column]:
    """publication_year, publication_month, publication_day of YYYY/MM/DD/ with optional parts (A2)."""
    parts = F.split(py, "/")
    return [F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(f"publication_{name}") for i, name in enumerate(("year", "month", "day"))]


def clean_date(pd: Column, py: Column) -> Column:
    """Year first where the date has none, without seasons, the first month of JAN-FEB and the first day of 3-5, in any case (A3)."""
    year, pd = r"\b\d{4}\b", F.coalesce(pd, F.lit(""))
    c = F.when(py.rlike(year) & ~pd.rlike(year), F.concat_ws(" ", py, pd)).otherwise(pd)
    c = F.regexp_replace(c, r"(?i)\b(?:SPR|SUM|FAL|WIN)\b", "")
    c = F.regexp_replace(c, r"(?i)\b([A-Z]{3})-[A-Z]{3}\b", "$1")
    c = F.regexp_replace(c, r"\b(\d{1,2})-\d{1,2}\b", "$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def timestamp_of(text: Column, year: Column, month: Column, day: Column, default=None) -> Column:
    """A point in time from an explicit string, else its parts up to the first missing, else the string's first 8 or 4
    characters, else ``default`` (A9)."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy MMM d", "yyyy MMM", "yyyy-MM")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    y, m, d = (c.try_cast("int") for c in (year, month, day))
    parts = F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.coalesce(m, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.when(m.isNotNull(), F.coalesce(d, F.lit(1))).otherwise(F.lit(1)).cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))
    heads = [F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")), F.try_to_timestamp(F.substring(text, 1, 4), F.lit("yyyy"))]
    return F.coalesce(*tries, F.when(y.isNotNull(), parts), *heads, F.lit(default).cast("timestamp"))


# Languages by name, three and two letters; special codes of bibliographic sources.
LANGUAGES = (("english", "eng", "en"), ("french", "fra", "fr"), ("german", "deu", "de"), ("spanish", "spa", "es"), ("italian", "ita", "it"), ("portuguese", "por", "pt"), ("dutch", "nld", "nl"), ("chinese", "zho", "zh"))
SPECIAL_LANGUAGES = {"fre": "fr", "ger": "de", "chi": "zh", "dut": "nl", "en_us": "en"}


def language_code(c: Column) -> Column:
    """Two letters from a name or a code of three or two, else __unknown__; null stays (A10)."""
    codes = {form: two for *forms, two in LANGUAGES for form in (*forms, two)} | SPECIAL_LANGUAGES
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit("__unknown__")))


#: The parts of an article that are read.
DAY = "struct<Year: string, Month: string, Day: string>"
ARTICLE = (
    "ArticleTitle: string, VernacularTitle: string, Abstract: struct<AbstractText: array<string>>, "
    f"Journal: struct<Title: string, JournalIssue: struct<PubDate: {DAY}>>, ArticleDate: {DAY}, "
    "AuthorList: struct<Author: array<struct<ForeName: string, LastName: string>>>, Language: string"
)
PUBMED = f"MedlineCitation struct<PMID: string, Article: struct<{ARTICLE}>>"


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, source, authors, lang, pub_ts) of PubMed articles; undated ones are dropped (A4)."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("multiLine", False).schema(PUBMED).load(path).select("MedlineCitation.*")
    a = F.col("Article")
    when = a["Journal"]["JournalIssue"]["PubDate"]
    issue = F.concat_ws(" ", when["Year"], when["Month"], when["Day"])
    second = a["ArticleDate"]
    stamp = F.coalesce(*[F.try_to_timestamp(issue, F.lit(f)) for f in ("yyyy MMM d", "yyyy MMM")], F.try_to_timestamp(F.concat_ws(" ", second["Year"], second["Month"], second["Day"]), F.lit("yyyy M d")))
    names = F.array_join(F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])), ", ")
    title = F.coalesce(F.nullif(a["ArticleTitle"], F.lit("")), a["VernacularTitle"])
    return rows.select(F.col("PMID").alias("pmid"), title.alias("title"), F.array_join(a["Abstract"]["AbstractText"], " ").alias("abstract"), a["Journal"]["Title"].alias("source"), names.alias("authors"), language_code(a["Language"]).alias("lang"), stamp.alias("pub_ts")).where("pub_ts is not null")


# Fields of MARC21 records by tag and subfield.
MARC_FIELDS = {"title": (("245", "a"),), "authors": (("100", "a"), ("700", "a")), "abstract": (("520", "a"),), "publication_date": (("269", "c"),), "lang": (("041", "a"),), "doi": (("024", "a"),)}


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """One row per MARC21 record, several values joined by commas, the main author first (A5)."""
    schema = "controlfield array<struct<_VALUE: string, _tag: string>>, datafield array<struct<_tag: string, subfield: array<struct<_VALUE: string, _code: string>>>>"
    rows = spark.read.format("xml").option("rowTag", "record").option("multiLine", False).schema(schema).load(path)

    def values(tag: str, code: str) -> Column:
        fields = F.flatten(F.transform(F.filter("datafield", lambda d: d["_tag"] == tag), lambda d: d["subfield"]))
        return F.transform(F.filter(fields, lambda s: s["_code"] == code), lambda s: s["_VALUE"])

    number = F.try_element_at(F.transform(F.filter("controlfield", lambda c: c["_tag"] == "001"), lambda c: c["_VALUE"]), F.lit(1))
    return rows.select(number.alias("record"), *[F.array_join(F.concat(*[values(*f) for f in fields]), ",").alias(name) for name, fields in MARC_FIELDS.items()])


def read_hal_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(docid, title, abstract, source, authors, url, lang) of an API dump: first non-empty field, lists joined by commas,
    NOT FOUND where missing; of equal urls the first docid stays (A6, A11). ``lines``: one object a line, not an array."""
    schema = "docid string, title_s array<string>, en_title_s array<string>, abstract_s array<string>, journalTitle_s string, uri_s string, authFullName_s array<string>, language_s string, submittedDate_s string"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    first = lambda *names: F.coalesce(*[F.nullif(F.array_join(n, ", "), F.lit("")) for n in names], F.lit("NOT FOUND"))
    one = lambda n: F.coalesce(F.nullif(n, F.lit("")), F.lit("NOT FOUND"))
    out = rows.select("docid", first("en_title_s", "title_s").alias("title"), first("abstract_s").alias("abstract"), one("journalTitle_s").alias("source"), first("authFullName_s").alias("authors"), one("uri_s").alias("url"), language_code(F.col("language_s")).alias("lang"), F.try_to_timestamp("submittedDate_s", F.lit("yyyy-MM-dd HH:mm:ss")).alias("pub_ts"))
    return first_of(out, "url", "docid")


def read_istex_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, title, abstract, source, genre, authors, doi, lang, pub_ts) of the hits of API answers: the host's title wins over the
    corpus name, the first language unless unknown, dates of three lengths; undated hits are dropped (A6). ``lines``: one answer
    a line."""
    host = "struct<title: string, genre: array<string>, pubdate: string>"
    hit = f"struct<id: string, corpusName: string, title: string, genre: array<string>, language: array<string>, doi: array<string>, host: {host}, publicationDate: string, abstract: string, author: array<struct<name: string>>>"
    hits = spark.read.schema(f"hits array<{hit}>").option("multiLine", not lines).json(path).select(F.explode("hits").alias("h")).select("h.*")
    first = F.try_element_at("language", F.lit(1))
    lang = F.when(first.isNull() | (first == "unknown"), F.lit("eng")).otherwise(first)
    when, size = F.col("publicationDate"), F.length("publicationDate")
    tries = lambda *formats: F.coalesce(*[F.try_to_timestamp(when, F.lit(f)) for f in formats])
    stamp = F.when(size > 8, tries("yyyy-MMM-d", "yyyy-M-d")).when(size > 4, tries("yyyy-MMM", "yyyy-M")).otherwise(tries("yyyy"))
    genre = F.when(F.size("genre") > 0, F.col("genre")).otherwise(F.col("host.genre"))
    out = hits.select(
        "id", "title", "abstract", F.coalesce("host.title", "corpusName").alias("source"), F.array_join(genre, ", ").alias("genre"), F.array_join("author.name", ", ").alias("authors"),
        F.try_element_at("doi", F.lit(1)).alias("doi"), language_code(lang).alias("lang"), stamp.alias("pub_ts"),
    )
    return out.where("pub_ts is not null")


def read_multivac_json(spark: SparkSession, path: str, lines: bool = False, default=None) -> DataFrame:
    """(id, title, abstract, type, source, authors, url, pub_ts) of a search index dump; missing texts are empty, the year is the journal's
    or, where that is invalid, the article's own, else ``default`` (A6)."""
    source = "struct<id: string, title: string, abstract: string, type: string, issuedate: string, serial: struct<journaltitle: string, issuedate: string>, hasauthor: array<struct<person: struct<name: string>>>, file: struct<url: string>>"
    rows = spark.read.schema(f"_source {source}").option("multiLine", not lines).json(path).select("_source.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = F.array_join(F.transform("hasauthor", lambda a: F.coalesce(a["person"]["name"], F.lit(""))), ", ")
    year = F.when(F.col("serial.issuedate") == "Invalide date", F.col("issuedate")).otherwise(F.col("serial.issuedate"))
    stamp = F.coalesce(F.try_to_timestamp(year, F.lit("yyyy")), F.lit(default).cast("timestamp"))
    return rows.select(*[text(c).alias(c) for c in ("id", "title", "abstract", "type")], F.coalesce("serial.journaltitle", F.lit("REPEC Database")).alias("source"), F.coalesce(names, F.lit("")).alias("authors"), text("file.url").alias("url"), stamp.alias("pub_ts"))


def read_isidore_json(spark: SparkSession, path: str, lines: bool = False, default=None) -> DataFrame:
    """(title, abstract, authors, url, source, pub_ts) of a flat dump; of equal urls the first title stays, a date that cannot be
    read becomes ``default`` (A6, A11)."""
    rows = spark.read.schema("title string, abstract string, authors string, url string, source string, date string").option("multiLine", not lines).json(path)
    stamp = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.lit(default).cast("timestamp"))
    out = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract", "authors", "url")], F.coalesce("source", F.lit("ISIDORE Database")).alias("source"), stamp.alias("pub_ts"))
    return first_of(out, "url", "title")


def first_of(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each value of ``by``."""
    columns = df.columns
    best = df.groupBy(by).agg(F.min(F.struct(order, *[c for c in columns if c not in (by, order)])).alias("best"))
    return best.select(by, "best.*").select(*columns)


def read_csv(spark: SparkSession, path: str, sep: str = "\t", line_ends: bool = True) -> DataFrame:
    """Any header, every column a string, empty values empty (A7). With ``line_ends`` values in quotes may hold line ends, and a file is one
    task's; without, large files are split."""
    rows = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=line_ends, escape='"')
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def press_articles(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, title, body, lang) of each <article> of a page."""
    found = pages.select(key, F.regexp_extract(html, r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<article.*?</article>"), F.lit(0))).alias("pos", "part"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = plain(F.regexp_extract("part", r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    body = plain(F.array_join(F.regexp_extract_all("part", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), " "))
    return found.select(key, F.col("pos").cast("long").alias("pos"), title.alias("title"), body.alias("body"), F.nullif("lang", F.lit("")).alias("lang"))


# The months and week days of press headers, and the classes of the parts of an article.
MONTHS = {
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
}
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
PRESS_CLASSES = {"title": "titreArticleVisu rdp__articletitle", "authors": "docAuthors", "publication": "DocPublicationName", "header": "DocHeader", "text": "DocText clearfix"}


def press_documents(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, title, authors, abstract, source, number, lang, pub_ts, section, error) of the articles of press archive pages.

    Authors are joined by "; ", paragraphs are kept as <p>; the publication's name is cut at ", ". The form of the date in the
    header tells the language, French or English; without one both are null. The section is the header's first part unless
    that belongs to the date. An article without a header or a title has an error.
    """
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<article.*?</article>"), F.lit(0))).alias("pos", "part"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    head = F.regexp_extract("part", r"(?s)<header[^>]*>(.*?)</header>", 1)
    of_class = lambda name: F.lit(rf'(?s)<(\w+)[^>]*\bclass\s*=\s*[\'"][^\'"]*{PRESS_CLASSES[name]}[^\'"]*[\'"][^>]*>(.*?)</\1>')
    parts = lambda where, name: F.transform(F.regexp_extract_all(where, of_class(name), F.lit(2)), plain)
    rows = found.select(key, F.col("pos").cast("long").alias("pos"), "part", head.alias("head"))
    rows = rows.withColumns({"titles": parts(F.col("head"), "title"), "writers": parts(F.col("head"), "authors"), "names": parts(F.col("head"), "publication"), "headers": parts(F.col("head"), "header")})
    texts = F.transform(F.regexp_extract_all(F.regexp_extract("part", r"(?s)<section[^>]*>(.*)</section>", 1), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), plain)
    paragraphs = F.concat(F.slice("titles", 2, 1_000_000), texts)
    name, detail = F.try_element_at("names", F.lit(1)), F.try_element_at("headers", F.lit(1))
    search = F.coalesce(detail, plain(F.col("head")))
    french = F.regexp_extract(search, rf"[0-3]?\d\s+(?:{'|'.join(MONTHS['fr'])})\s+(?:19|20)\d\d", 0)
    english = F.regexp_extract(search, rf"\b(?:{'|'.join(MONTHS['en'])})\s+[0-3]?\d,\s+(?:19|20)\d\d", 0)
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS["fr"], 1) for x in (m, str(i))])
    words = F.split(french, r"\s+")
    stamp_fr = F.try_to_timestamp(F.concat_ws("-", F.try_element_at(words, F.lit(3)), F.try_element_at(numbers, F.try_element_at(words, F.lit(2))), F.try_element_at(words, F.lit(1))), F.lit("yyyy-M-d"))
    stamp_en = F.try_to_timestamp(F.regexp_replace(english, r"\s+", " "), F.lit("MMMM d, yyyy"))
    first = F.try_element_at(F.split(detail, ", "), F.lit(1))
    dated = first.rlike(rf"(?i)\b(?:{'|'.join((*MONTHS['fr'], *MONTHS['en'], *DAYS))})\b") | first.rlike(r"^[\d\s/.-]*$")
    error = F.when(plain(F.col("head")) == "", F.lit("no header")).when(F.size("titles") == 0, F.lit("no title"))
    return rows.select(
        key, "pos", F.try_element_at("titles", F.lit(1)).alias("title"), F.array_join("writers", "; ").alias("authors"),
        F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n").alias("abstract"),
        F.try_element_at(F.split(name, ", "), F.lit(1)).alias("source"), F.try_element_at(F.split(name, ", "), F.lit(2)).alias("number"),
        F.when(french != "", F.lit("fr")).when(english != "", F.lit("en")).alias("lang"), F.when(french != "", stamp_fr).otherwise(stamp_en).alias("pub_ts"),
        F.when(~dated, first).alias("section"), error.alias("error"),
    )


def good(docs: DataFrame) -> DataFrame:
    """Documents without an error; the others are kept in the table but skipped downstream."""
    return docs.where("error is null").drop("error")


def new_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct terms the dictionary lacks."""
    return terms.select("term").distinct().join(known.select("term"), "term", "left_anti")


def load_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(term, n, is_new) of the dictionary after a load: the known terms and the new ones, with their number of words."""
    flag = lambda df, new: df.select("term", F.lit(new).alias("is_new"))
    every = flag(terms, True).unionAll(flag(known, False)).groupBy("term").agg(F.min("is_new").alias("is_new"))
    return every.select("term", (F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1).alias("n"), "is_new")


DELIMITER = "|&|"


def export_lists(map_: DataFrame, main: DataFrame, stop: DataFrame, groups: DataFrame) -> DataFrame:
    """(status, label, forms): one row per main form, map before main before stop; sub forms only in forms."""
    label = lambda df, name, rank: df.select(F.lit(rank).alias("rank"), F.lit(name).alias("status"), F.col("term").alias("label"))
    rows = label(map_, "map", 1).unionByName(label(main.join(map_.select("term"), "term", "left_anti"), "main", 2)).unionByName(label(stop, "stop", 3))
    rows = rows.join(groups.select(F.col("subform").alias("label")), "label", "left_anti")
    forms = groups.groupBy(F.col("mainform").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("subform")), DELIMITER).alias("forms"))
    return rows.join(forms, "label", "left").select("status", "label", F.coalesce("forms", F.lit("")).alias("forms"), "rank").orderBy("rank", "label").drop("rank")


def import_lists(rows: DataFrame, clean) -> tuple[DataFrame, DataFrame]:
    """(list_name, term) and (mainform, subform) of a term list.

    ``label`` is required, ``status`` defaults to map, ``forms`` may be missing; any other column is an error. Rows with an
    empty label or a strange status are skipped; main holds all terms of map.
    """
    strange = set(rows.columns) - {"label", "status", "forms"}
    if strange or "label" not in rows.columns:
        raise ValueError(f"a term list has label, status and forms, not {sorted(strange)}")
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("map")) if "status" in rows.columns else F.lit("map")
    forms = F.split(F.coalesce("forms", F.lit("")), r"\|&\|") if "forms" in rows.columns else F.array(F.lit(""))
    read = rows.select(status.alias("status"), clean(F.col("label")).alias("label"), F.transform(forms, lambda c: clean(c)).alias("forms")).where("label <> '' AND status IN ('map', 'main', 'stop')")
    each = read.select("status", "label", F.explode(F.concat(F.array("label"), "forms")).alias("term")).where("term <> ''")
    lists = each.select(F.explode(F.when(F.col("status") == "map", F.array(F.lit("map"), F.lit("main"))).otherwise(F.array("status"))).alias("list_name"), "term").distinct()
    return lists, each.where("term <> label").select(F.col("label").alias("mainform"), F.col("term").alias("subform")).distinct()


def export_documents(docs: DataFrame, fields: list[str]) -> DataFrame:
    """The chosen fields as strings, empty where missing."""
    return docs.select(*[(F.coalesce(F.col(f).cast("string"), F.lit("")) if f in docs.columns else F.lit("")).alias(f) for f in fields])

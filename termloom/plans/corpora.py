"""The supplied tables seen as corpora, in Spark and in the SQL that checks it.

TEXT takes every document's source as its corpus; BASKET takes orders as documents, nations as corpora and the names, brands
and types of the parts ordered as terms, weighted by quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, doc_id, title, abstract, lang, pub_date, project, source_type)"""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("corpus_id"), "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), "lang",
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") * 37 % 5840).cast("int")).alias("pub_date"),
        (number % 5).alias("project"), (number % 3).alias("source_type"),
    )


TEXT_SQL = r"""
docs AS (
    SELECT source AS corpus_id, doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, lang,
           DATE '2000-01-01' + CAST(doc_id * 37 % 5840 AS INTEGER) AS pub_date,
           CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 5 AS project,
           CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) % 3 AS source_type
    FROM documents
), tokens AS (
    SELECT corpus_id, doc_id, unnest(regexp_extract_all(lower(abstract), '[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*')) AS term FROM docs
), doc_terms AS MATERIALIZED (
    SELECT corpus_id, doc_id, term, CAST(count(*) AS DOUBLE) AS weight FROM tokens WHERE length(term) > 1 GROUP BY ALL
)"""


def region_sql(column: str, lang: str) -> str:
    """The stem of a word by the endings of its language."""
    cases = " ".join(f"WHEN '{name}' THEN regexp_replace({column}, '{T.region_pattern(name)}', '\\1')" for name in T.ENDINGS)
    return f"CASE WHEN length({column}) <= 3 THEN {column} ELSE CASE {lang} {cases} ELSE {column} END END"


LANGUAGE_KEY_SQL = f"array_to_string(list_transform(list_filter(string_split_regex(term, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''), lambda w: {region_sql('w', 'lang')}), ' ')"


def text_terms(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(corpus_id, doc_id, *more, term, weight): single words of two characters and more, counted within the document's row."""
    docs = text_documents(spark, sf_dir)
    counts = docs.select("corpus_id", "doc_id", *more, F.explode(T.counted(T.tokens(F.lower("abstract")))).alias("t"))
    return counts.select("corpus_id", "doc_id", *more, "t.term", "t.weight").where(F.length("term") > 1)


def text_words(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """(corpus_id, doc_id, term): the words of ``text_terms``, as often as they occur or once a row of ``documents``, where no counts by document are wanted.

    The explode is an outer one, as Spark asks before an inner one whether there are words, and splits every text anew for that.
    """
    words = T.tokens(F.lower("abstract"))
    rows = text_documents(spark, sf_dir).select("corpus_id", "doc_id", F.explode_outer(F.array_distinct(words) if distinct else words).alias("term"))
    return rows.where(F.length("term") > 1)


MOST_LISTED = 100_000
LINES = 250_000


def short(terms: DataFrame) -> DataFrame:
    """A list or groups that go to every task where they are at most MOST_LISTED rows, counted first: rows of documents then stay where they are."""
    return F.broadcast(terms) if terms.limit(MOST_LISTED + 1).count() <= MOST_LISTED else terms


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus_id, doc_id, pub_date, term, weight)

    Parts and customers grow with the orders, so neither is broadcast. A line meets its part as one row and is dealt by order once; its
    terms part there, where they are summed. All joins are in tasks of some LINES lines or orders,
    however many shuffle partitions are set.
    """
    get = lambda name: table(spark, sf_dir, name)
    tasks = {name: get(name).count() // LINES + 1 for name in ("lineitem", "orders")}
    nations = get("nation").select("n_nationkey", F.col("n_name").alias("corpus_id"))
    people = get("customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "corpus_id")
    orders = get("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("pub_date")).repartition(tasks["orders"], "o_custkey")
    orders = orders.join(people.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "pub_date", "corpus_id")
    parts = get("part").select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("terms"))
    lines = get("lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(tasks["lineitem"], "l_partkey")
    dealt = lines.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).repartition(tasks["lineitem"], "l_orderkey")
    rows = dealt.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("corpus_id", F.col("o_orderkey").alias("doc_id"), "pub_date", F.explode("terms").alias("term"), "l_quantity")
    return rows.groupBy("corpus_id", "doc_id", "pub_date", "term").agg(F.sum("l_quantity").alias("weight"))


BASKET_SQL = """
basket AS (
    SELECT n_name AS corpus_id, o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS pub_date, term, sum(l_quantity) AS weight
    FROM lineitem JOIN (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS term FROM part) ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL
), forms AS (
    SELECT min(p_name) OVER (PARTITION BY split_part(p_name, ' ', 2)) AS mainform, p_name AS subform
    FROM (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '% %')
), groups AS (SELECT * FROM forms WHERE mainform <> subform)"""


def basket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mainform, subform): part names that share their second word, under the smallest of them."""
    names = table(spark, sf_dir, "part").select("p_name").where("p_name LIKE '% %'").distinct().withColumn("key", F.split_part("p_name", F.lit(" "), F.lit(2)))
    first = names.groupBy("key").agg(F.min("p_name").alias("mainform"))
    return short(names.join(first, "key").where("mainform <> p_name").select("mainform", F.col("p_name").alias("subform")))


def basket_list(spark: SparkSession, sf_dir: str, kind: str = "name") -> DataFrame:
    """(term): the part names, or the brands and types."""
    parts = table(spark, sf_dir, "part")
    return short((parts.select(F.col("p_name").alias("term")) if kind == "name" else parts.select(F.explode(F.array("p_brand", "p_type")).alias("term"))).distinct())

"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import exact, langid, mixing, packing, similar, subwords
from termloom.llm.store import discard, staged_at

#: A document whose language is unknown, or that no language is likelier than this to hold, is rejected.
LEAST_LANGUAGE_SCORE = 0.3
SIZE_POWER = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learned from the given ones; a row's columns stay as they are.

    Rejected: null texts, texts without a letter, and texts for which no learned language has a pooled probability of
    LEAST_LANGUAGE_SCORE; where no row has a language to learn, all texts with a letter stay. Rows are judged by doc_id
    and text.
    """
    network = langid.train(docs, learn=F.lit(True))
    if network is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = langid.identify(docs.withColumn("_row", F.struct(F.col("doc_id").alias("id"), digest.alias("mark"))), network, key="_row")
    bad = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE)).select(F.col("_row.id").alias("_bad"), F.col("_row.mark").alias("_mark")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (digest == bad["_mark"]), "left_anti")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest doc_id; null and empty texts are one text. See exact.drop_copies."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a Jaccard similarity of 0.8 and more over five-word shingles: the smallest
    doc_id. Rows without a doc_id and texts without words stay. See similar.similar_groups."""
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their mixture: sources at their row count to the power SIZE_POWER; a null source is the
    source ''. Rows that repeat a doc_id stay together, at its first place. See mixing.mix."""
    placed = mixing.mix(docs, mixing.size_weights(docs, SIZE_POWER))
    return mixing.in_mixed_order(docs, placed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, one sequence each; null and empty texts are one piece of the end id. See packing.pack."""
    return packing.pack(docs, subwords.vocabulary_path(), end_id=0, longest=1024, ids=False)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Learned models have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged_at(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)  # the next stage is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""An inverted index with positions, written once, and searches in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T


def write_index(docs: DataFrame, text: Column, path: str, key: str = "doc_id") -> None:
    """Write (term, key, positions) of every word of the texts, in lower case, in ranges of terms and sorted by them, so that a search reads
    the files and row groups of its terms only. A frequent term is spread over several ranges by the key. Keys are unique; null texts have no words."""
    rows = docs.select(F.col(key), F.explode(T.placed(T.tokens(F.lower(text)))).alias("t")).select("t.term", key, "t.positions")
    rows.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(path)


class Index:
    """Searches of a written index. Every search is a table of keys, each once."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.rows, self.key = spark.read.parquet(path), key

    def postings(self, *terms: str) -> DataFrame:
        return self.rows.where(F.col("term").isin(*{t.lower() for t in terms}))

    def any_of(self, *terms: str) -> DataFrame:
        return self.postings(*terms).select(self.key).distinct()

    def all_of(self, *terms: str) -> DataFrame:
        each = [self.postings(t).select(self.key) for t in sorted({t.lower() for t in terms})]
        return reduce(lambda a, b: a.join(b, self.key, "left_semi"), each)

    def phrase(self, *parts: str) -> DataFrame:
        """Keys whose text has the parts side by side: places of each part, shifted to the first one, are intersected."""
        shifted = lambda i: F.transform("positions", lambda p: p - i)
        found = self.postings(parts[0]).select(self.key, F.col("positions").alias("at"))
        for i, part in enumerate(parts[1:], 1):
            next_ = self.postings(part).select(self.key, shifted(i).alias("here"))
            found = found.join(next_, self.key).select(self.key, F.array_intersect("at", "here").alias("at")).where(F.size("at") > 0)
        return found.select(self.key)

    def both(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, self.key, "left_semi")

    def without(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, self.key, "left_anti")

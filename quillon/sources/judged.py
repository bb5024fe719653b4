"""The judge cache: outcomes of judged answers by a key of all that an outcome depends on.

The cache is a table bucketed and sorted by its key. `get` joins a batch of keys to it: only the batch is shuffled, to the buckets' layout;
the cache is read as it lies. `put` appends, and the outcome put last counts, so that putting a key again replaces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
#: What divides the parts of a key.
PART = "\u001f"


def cache_key(*parts: Column) -> Column:
    """sha256 of the parts of a key: version, rubric, question, answer, model, sampling parameters, endpoint; nulls count as empty."""
    return F.sha2(F.concat_ws(PART, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


class JudgeCache:
    """A bucketed table (cache_key, outcome, put_no) under a name, its files in a folder."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def put(self, outcomes: DataFrame) -> None:
        """Append outcomes (cache_key, outcome); of several rows of a key in one batch the greatest outcome counts. Keys are dealt to buckets
        before writing, so that a put adds a file to each bucket at most."""
        last = 0
        if self.spark.catalog.tableExists(self.name):
            last = self.spark.table(self.name).agg(F.max("put_no")).first()[0] or 0
        rows = outcomes.groupBy("cache_key").agg(F.max("outcome").alias("outcome")).withColumn("put_no", F.lit(last + 1))
        dealt = rows.repartition(self.buckets, "cache_key")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "cache_key").sortBy("cache_key").option("path", self.path).saveAsTable(self.name)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` with cached: their outcome, null where there is none."""
        table = self.spark.table(self.name).groupBy("cache_key").agg(F.max_by("outcome", "put_no").alias("cached"))
        return keys.join(table.hint("shuffle_hash"), "cache_key", "left")

"""Ingestion: counters, enrichment, neighbours, durations, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counters(rows: DataFrame, column: str) -> DataFrame:
    """mime and n over counters written as mime=n;mime=n; the last equals sign parts them, and other text is dropped."""
    pairs = rows.select(F.explode(F.split(column, ";")).alias("pair"))
    parts = pairs.select(F.regexp_extract("pair", "^(.*)=([^=]*)$", 1).alias("mime"), F.regexp_extract("pair", "^(.*)=([0-9]+)$", 2).alias("n"))
    return parts.where("mime <> '' and n <> ''").groupBy("mime").agg(F.sum(F.col("n").cast("bigint")).alias("n"))


def enriched(cards: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Cards with what a manifest adds; its title wins where it has one."""
    joined = cards.join(manifest, key, "left")
    title = F.coalesce(F.nullif(F.trim("manifest_title"), F.lit("")), F.col("title"))
    return joined.withColumn("title", title).drop("manifest_title")


def neighbours(rows: DataFrame, group: str, order: str, width: int) -> DataFrame:
    """group, order and neighbours: how many rows of the group lie within `width` by number. The band becomes an
    equality: each row is listed under the numbers around it."""
    around = rows.select(group, F.explode(F.sequence(F.col(order) - width, F.col(order) + width)).alias("near"), F.col(order).alias("own")).where("near <> own")
    met = around.join(rows.select(group, F.col(order).alias("near")), [group, "near"])
    return met.groupBy(group, F.col("own").alias(order)).agg(F.count("*").alias("neighbours"))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration; null when it is none, or not above zero."""
    def part(unit: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))

    total = F.floor(part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S")).cast("bigint")
    return F.when(text.rlike(r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$") & (total > 0), total)


def _drawn(rows: DataFrame, group: str, key: str, seed: int, most: int) -> DataFrame:
    """The first `most` rows of each group in the seeded order, numbered (nth). Groups are cut down where their rows lie before these meet."""
    order = W.partitionBy(group).orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def samples(rows: DataFrame, group: str, key: str, good: Column, count: int, seed: int) -> DataFrame:
    """Up to `count` (1 to 24) different good rows of each group, in a seeded random order; at most max(8 * count, 16) are tried."""
    if not 1 <= count <= 24:
        raise ValueError(f"count is {count}, not 1 to 24")
    tried = _drawn(rows, group, key, seed, max(8 * count, 16)).where(good)
    own = W.partitionBy(group).orderBy("nth")
    return tried.withColumn("place", F.row_number().over(own) - 1).where(F.col("place") < count).drop("nth")


def random_entry(rows: DataFrame, group: str, key: str, good: Column, seed: int, articles_only: bool = False) -> DataFrame:
    """One row of each group: the first good one of 5 draws (400 for articles only), else the last one drawn."""
    budget = 400 if articles_only else 5
    tried = _drawn(rows, group, key, seed, budget).withColumn("order", F.when(good, F.col("nth") - budget - 1).otherwise(budget - F.col("nth")))
    first = W.partitionBy(group).orderBy("order")
    return tried.withColumn("place", F.row_number().over(first)).where("place = 1").drop("nth", "order", "place")

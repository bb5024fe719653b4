"""Fusion and ordering of ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 20


def restart_ranks(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Ranks from 0 within each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)


def best_per_article(hits: DataFrame) -> DataFrame:
    """The best-scored hit of each article of a query."""
    order = W.partitionBy("item_id", "zim_id", "path").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def reciprocal_rank(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """item_id, zim_id, path, score, source and rank: reciprocal rank fusion over all candidates of a query.

    Candidates of one source arrive in rank order; an article's source is that of its smallest (rank, source)."""
    fused = candidates.groupBy("item_id", "zim_id", "path").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("rank", "source")).alias("first")
    )
    order = W.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "zim_id", "path")
    return fused.select("item_id", "zim_id", "path", "score", F.col("first.source").alias("source"), (F.row_number().over(order) - 1).alias("rank"))


def round_robin(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion within each archive, then archives take turns: by rank within the archive, then archive."""
    fused = candidates.groupBy("item_id", "zim_id", "path").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("rank", "source")).alias("first")
    )
    own = F.row_number().over(W.partitionBy("item_id", "zim_id").orderBy(F.desc(F.round("score", 9)), "path")) - 1
    turns = F.row_number().over(W.partitionBy("item_id").orderBy("turn", "zim_id")) - 1
    return fused.withColumn("turn", own).select("item_id", "zim_id", "path", "score", F.col("first.source").alias("source"), turns.alias("rank"))


def flat_union(candidates: DataFrame) -> DataFrame:
    """Candidates without fusion: by (zim_id, source, rank)."""
    order = W.partitionBy("item_id").orderBy("zim_id", "source", "rank", "path")
    return candidates.withColumn("place", F.row_number().over(order) - 1)


def source_agreement(candidates: DataFrame) -> DataFrame:
    """item_id and agreement: the mean Jaccard likeness of the path sets of each two sources; 0 with fewer than two."""
    sets = candidates.groupBy("item_id", "source").agg(F.collect_set("path").alias("paths"))
    a, b = sets.select("item_id", F.col("source").alias("s1"), F.col("paths").alias("p1")), sets.select("item_id", F.col("source").alias("s2"), F.col("paths").alias("p2"))
    pairs = a.join(b, "item_id").where("s1 < s2").select("item_id", (F.size(F.array_intersect("p1", "p2")) / F.nullif(F.size(F.array_union("p1", "p2")), F.lit(0))).alias("j"))
    mean = pairs.groupBy("item_id").agg(F.avg("j").alias("agreement"))
    return sets.select("item_id").distinct().join(mean, "item_id", "left").select("item_id", F.round(F.coalesce("agreement", F.lit(0.0)), 6).alias("agreement"))


def edges_first(rows: DataFrame, group: str, rank: str) -> DataFrame:
    """Even ranks forward, then odd ranks backward, in groups of more than two."""
    n = F.count("*").over(W.partitionBy(group))
    key = F.when((n > 2) & (F.col(rank) % 2 == 1), 2 * n - F.col(rank)).otherwise(F.col(rank))
    return rows.withColumn("key", key).withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("key")) - 1).drop("key")


def append_unseen(base: DataFrame, extra: DataFrame, cap: int) -> DataFrame:
    """Base rows in their order, then up to `cap` extra rows of each query whose article the base does not have."""
    new = extra.join(base, ["item_id", "zim_id", "path"], "left_anti").dropDuplicates(["item_id", "zim_id", "path"])
    nth = F.row_number().over(W.partitionBy("item_id").orderBy("rank", "zim_id", "path"))
    new = new.withColumn("nth", nth).where(F.col("nth") <= cap)
    size = base.groupBy("item_id").agg((F.max("rank") + 1).alias("start"))
    added = new.join(size, "item_id", "left").select("item_id", "zim_id", "path", (F.coalesce("start", F.lit(0)) + F.col("nth") - 1).alias("rank"))
    return base.select("item_id", "zim_id", "path", "rank").unionByName(added)

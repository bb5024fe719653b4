"""A stored inverted index, and all-term top-k search that skips blocks by the greatest score they can give.

The articles of an archive are dealt, by a hash of their path, to ranges of about BLOCK. A block holds the postings of one term in one range:
paths with the term's number and the article's length, and the greatest weight that these give. A term's rarity in an archive comes from the
sizes of its blocks, so that nothing is joined to blocks when they are made. Blocks of all terms are cut by the same ranges,
so that the sum of the greatest scores of a query's terms bounds what any article of a range can score, and a range that lacks
one of the terms has no match. Blocks lie in Parquet, partitioned by a hash of the term: a search opens the buckets of its
terms only, and reads the postings of the ranges that it has to.

A search has two rounds. The first scores the ranges with the greatest bounds of each query and archive, which gives the score that
the k-th article has at least. The second scores the ranges whose bound reaches that; all others are skipped. Ranks are those of a full search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import search
from quillon.sources.tables import kept, small

BUCKETS, BLOCK = 64, 128
#: Articles that a task indexes, about.
PART = 16_384
#: Ranges that the first round scores, and by how much a bound may miss a score for rounding.
FIRST, SLACK = 2, 1e-8
#: Terms of a batch of queries that are broadcast to the blocks.
MAX_TERMS = 200_000


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(articles: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write the index of articles (zim_id, path, text) to a folder: `archives` (zim_id, n, avgdl) and `blocks` (bucket, zim_id, term, range,
    best, size, docs).

    Articles are dealt by range before they are cut into terms, so that a range's postings are gathered where they are made: texts are
    shuffled once, postings and blocks never. A task has about PART articles, and writes a file for each bucket."""
    archives = kept(articles.groupBy("zim_id").agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col("text")))).alias("avgdl")))
    archives.coalesce(1).write.parquet(f"{path}/archives")
    sizes = small(archives.withColumn("ranges", F.ceil(F.col("n") / block)))
    placed = articles.select("zim_id", "path", "text").join(sizes, "zim_id").withColumn("range", F.pmod(F.xxhash64("path"), F.col("ranges")).cast("int"))
    parts = max(articles.sparkSession.sparkContext.defaultParallelism, -(-(archives.agg(F.sum("n")).first()[0] or 0) // PART))
    dealt = placed.select("zim_id", "range", "path", "text", "avgdl").repartition(parts, "zim_id", "range")
    listed = search.postings(dealt, "range", "avgdl").groupBy("zim_id", "range", "term").agg(
        F.max(search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("best"), F.collect_list(F.struct("path", "tf", "dl")).alias("docs"))
    rows = listed.select(bucket_of(F.col("term"), buckets).alias("bucket"), "zim_id", "term", "range", "best", F.size("docs").alias("size"), "docs")
    rows.sortWithinPartitions("bucket", "term", "zim_id", "range").write.partitionBy("bucket").parquet(f"{path}/blocks")


@dataclass(frozen=True)
class Found:
    """Rows (item_id, zim_id, path, score, rank), and the blocks (item_id, zim_id, range, round) with their terms' number: those that
    the index has for a query's terms (asked), and those whose postings were scored (read)."""

    rows: DataFrame
    asked: DataFrame
    read: DataFrame


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, buckets: int = BUCKETS) -> Found:
    """The k best articles of each archive with all terms of queries (item_id, terms)."""
    terms = kept(queries.select("item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).withColumn("bucket", bucket_of(F.col("term"), buckets)))
    few = terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    opened = sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())  # as many as there are buckets at most
    index = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(opened))
    asked = F.broadcast(terms.drop("bucket")) if few else terms.drop("bucket")
    heads = kept(index.select("zim_id", "term", "range", "best", "size").join(asked, "term"))
    frequent = heads.select("zim_id", "term", "range", "size").distinct().groupBy("zim_id", "term").agg(F.sum("size").alias("df"))
    frequent = small(frequent.join(spark.read.parquet(f"{path}/archives"), "zim_id"))
    bound = F.sum(search.rarity(F.col("df"), F.col("n")) * F.col("best")).alias("bound")
    live = heads.join(frequent, ["zim_id", "term"]).groupBy("item_id", "zim_id", "range").agg(F.count("*").alias("n_held"), F.max("n_terms").alias("n_terms"), bound).where("n_held = n_terms")
    by_bound = W.partitionBy("item_id", "zim_id").orderBy(F.desc("bound"), "range")
    live = kept(live.withColumn("nth", F.row_number().over(by_bound)))

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = ranges.select("item_id", "n_terms", "zim_id", "range").join(terms.select("item_id", "term"), "item_id")
        postings = index.select("zim_id", "term", "range", "docs").join(F.broadcast(wanted) if few_ranges(ranges) else wanted, ["zim_id", "term", "range"])
        rows = postings.join(frequent, ["zim_id", "term"]).select("item_id", "n_terms", "zim_id", "df", "n", "avgdl", F.inline("docs"))
        score = search.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))
        met = rows.groupBy("item_id", "n_terms", "zim_id", "path").agg(F.count("*").alias("n_met"), F.sum(score).alias("score"))
        return met.where("n_met = n_terms").select("item_id", "zim_id", "path", "score")

    def few_ranges(ranges: DataFrame) -> bool:
        return ranges.limit(MAX_TERMS // 10 + 1).count() <= MAX_TERMS // 10

    first = kept(live.where(F.col("nth") <= FIRST))
    one = kept(search.ranked(scored(first), k, "item_id", "zim_id"))
    least = one.where(F.col("rank") == k - 1).select("item_id", "zim_id", F.col("score").alias("least"))
    rest = live.where(F.col("nth") > FIRST).join(least, ["item_id", "zim_id"], "left")
    second = kept(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least"))
    rows = search.ranked(one.drop("rank").unionByName(scored(second)), k, "item_id", "zim_id")
    return Found(rows, heads.select("item_id", "zim_id", "range", "term"), first.unionByName(second).select("item_id", "zim_id", "range", "n_terms"))

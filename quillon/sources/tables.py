"""Loaders of the tables, and the domain tables read from them.

A document is an article: its archive is the number in `source`, its path doc_<id>, its title its first four words.
A benchmark item is a question: the query is its first eight words, and the articles that hold its text are expected.
An embedding is a chunk vector, its archive the label. An event is a stage record of a trace.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, of `spark.checkpoint.dir`. Where none is set: a temporary one in local mode, else an error, as
    the machines of a cluster would not see each other's."""
    home = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return home or tempfile.mkdtemp(prefix="quillon-")


def folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """`rows` written out in the shared folder, so that what is built on them neither repeats their work nor their plan."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


#: Rows that may be broadcast, of a few short columns.
MAX_SMALL = 200_000


def small(rows: DataFrame, most: int = MAX_SMALL) -> DataFrame:
    """`rows` written out, and broadcast to what they are joined with where they are `most` at most."""
    rows = kept(rows)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in as many partitions as there are cores, where a scan gives fewer (one large row group, a few small files)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zim_id, path, title, text, lang, n_chars and doc_id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.substring("source", 4, 9).cast("int").alias("zim_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"),
        T.first_words(F.col("text"), 4).alias("title"), "text", "lang", "n_chars", "doc_id",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, raw (the query) and passage (the text to be found)."""
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", T.first_words(F.col("text"), 8).alias("raw"), F.col("text").alias("passage"))


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace records: run_id, stage, seq (a total order), duration_ms and params."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), "ts",
        F.col("value").alias("duration_ms"), F.col("props").alias("params"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, zim_id, article_id and embedding."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("zim_id"), F.floor(F.col("vec_id") / 4).alias("article_id"), "embedding"
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged and unjudged answers: question_id, capability (the language; Spanish stands for out_of_corpus), verdict, abstained, tokens and slice (the source)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = (
        F.when(F.col("quality").isNull(), "unjudged").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct")
        .when(F.col("quality") == 1, "partial").otherwise("incorrect")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("question_id"), F.when(F.col("lang") == "es", "out_of_corpus").otherwise(F.col("lang")).alias("capability"), F.col("source").alias("slice"), verdict.alias("verdict"),
        (F.col("doc_id") % 7 == 0).alias("abstained"), "n_chars", F.col("text"), "quality", "toxic",
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 + 1).alias("hit_rank"),
    )

"""The corpus pipeline: classify, deduplicate, decontaminate, mix, shard.

Each stage takes the documents that the one before kept and returns the same columns, but for the last, which adds
size, text_crc32, law, shard, slot and grown_shard. Stages are written as Parquet and read back in between, in
the folder of `spark.checkpoint.dir`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, quality, sharding, simhash
from quillon.llm._common import shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source up to its target; a document taken twice has two rows, one left out has none."""
    return mixing.mixed(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.assign_shards(docs, keep=True)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", distinct_documents),
    ("decontaminate", uncontaminated_documents),
    ("mix", mixed_documents),
    ("shard", sharded_documents),
]

#: Fingerprints, the fitted classifier and the keyed permutations are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. A stage's files go when the next one's are written; those that the result is read from stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sinks: keyed upserts, deletes, replacing loads and retention on Parquet tables.

Parquet has no MERGE: a sink reads the table, makes its next state as a DataFrame, writes that beside it and then swaps the
two, so that a failed write leaves the old table in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.tables import kept


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` with the rows of `new` put in by key; of several new rows of one key any one wins, so pass one."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def last_write(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row written last of each key."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(sequence)))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def without(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` less the rows whose key is in `gone`: a delete, also as a cascade over other tables."""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write `rows` beside the table at `path` and swap by two renames: readers never see a part of a table, but between the two, for a moment,
    none."""
    spark = rows.sparkSession
    staging = f"{path}.{uuid.uuid4().hex}"
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop(f"{staging}.old")
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), old)
    fs.rename(hadoop(staging), hadoop(path))
    fs.delete(old, True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition_by: list[str] | None = None) -> None:
    replace_table(upserted(spark.read.parquet(path), new, keys), path, partition_by)


def reload_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Wipe and reload the partitions that `rows` has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def prune_traces(spark: SparkSession, path: str, runs: DataFrame, older_than_days: int, now: Column, partition: str = "part") -> int:
    """Take the traces out of the rows of runs (run_id, started_at) that began more than so many days before `now`; the number of rows changed.

    Runs are chosen by a semi-join, and only partitions that hold such rows are written anew; the files of others stay. 0 days or fewer do nothing."""
    if older_than_days <= 0:
        return 0
    old = runs.where(F.col("started_at") < now - F.make_interval(days=F.lit(older_than_days))).select("run_id").distinct()
    table = spark.read.parquet(path)
    rows = table.where("trace is not null").join(old, "run_id", "left_semi")
    touched = {r[partition]: r["count"] for r in rows.groupBy(partition).count().collect()}  # partitions
    if touched:
        marked = table.where(F.col(partition).isin(list(touched))).join(old.withColumn("old", F.lit(True)), "run_id", "left")
        kind = table.schema["trace"].dataType
        pruned = marked.withColumn("trace", F.when(F.col("old").isNull(), F.col("trace")).otherwise(F.lit(None).cast(kind))).select(*table.columns)
        reload_partitions(kept(pruned), path, partition)
    return sum(touched.values())

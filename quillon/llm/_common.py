"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`. Where that is unset, a temporary folder in local mode (tests, a
    laptop); on a cluster an error, as its machines would not see each other's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """`df` by way of a file in `folder`, of which Spark knows the size. A checkpoint keeps the estimate of what it was made from, and that of a join is
    the product of its sides': over rounds of joins its digits double, until the driver is full of them."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def grown(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that grows with the input: joined by a shuffle whatever its size, so that it never passes through the driver, as
    a broadcast does. Steps that are repeated would broadcast a table each time, each by a thread of its own."""
    return df.hint("merge")


#: Rows of a few numbers that are worth a task.
TASK_ROWS = 100_000


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most so many rows of a few numbers, in no more partitions than these need, or four a core. Steps that are repeated over
    what is left else have a task for each partition, however little that is, and the driver keeps a record of every task."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def packed(df: DataFrame, name: str) -> Column:
    """All columns of `df` as one struct called `name`: what is added beside it can clash with none of them."""
    return F.struct(*columns_of(df)).alias(name)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of `df`; maps, which have none, go in as JSON."""
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else c for c, kind in zip(columns_of(df), kinds, strict=True)])


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


#: Keys (longs) that may be broadcast: about 60 MB as a hash table.
MAX_KEYS = 1_000_000


def without_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`rows` less those whose `key` is in `gone`. Up to MAX_KEYS keys are broadcast, so that wide rows stay where they are;
    more are joined by a shuffle."""
    if gone.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti")


def running_start(df: DataFrame, rows: int, group: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows that come before, within `group`.

    The order is any fixed one: by a hash bucket of `order`, then by `order`. About sqrt(rows) buckets keep both the
    rows in a bucket and the buckets in a group few, so that a group with a third of all rows is still
    summed by many tasks. Rows equal in all of `order` may swap places. `group` and `order` hold no nulls that matter:
    they compare by plain equality, so callers pass non-null keys.
    """
    buckets = max(1, math.isqrt(max(rows, 1)))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "__bucket"]
    own = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = (
        df.groupBy(*keys).agg(F.sum(weight).alias("__sum"))
        .withColumn("__offset", F.sum("__sum").over(before) - F.col("__sum")).drop("__sum")
    )
    return (
        df.withColumn("__within", F.sum(weight).over(own) - F.col(weight))
        .join(sums, keys)
        .withColumn(out, F.col("__offset") + F.col("__within"))
        .drop("__bucket", "__within", "__offset")
    )


ROUNDS = 6
WALKS = 64


def permuted(index: Column, size: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Where a keyed permutation of [0, size) sends `index`, as a column of JVM-side expressions.

    An unbalanced Feistel network permutes the least power of two that holds `size`; cycle walking sends values of
    `size` and above on until they fall inside. At least half of the domain is inside, so that a walk of WALKS steps
    fails with odds of 2^-64; it would raise an error then, never return a wrong place.
    """
    bits = F.greatest(F.lit(2), F.ceil(F.log2(size.cast("double"))).cast("int"))
    low = F.floor(bits / 2).cast("int")
    low_mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), low) - 1
    high_mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - low) - 1

    def step(pair: Column, r: Column) -> Column:
        high, down = pair["high"], pair["low"]
        return F.when(
            r % 2 == 0, F.struct(high.bitwiseXOR(F.xxhash64(down, r, seed).bitwiseAND(high_mask)).alias("high"), down.alias("low"))
        ).otherwise(F.struct(high.alias("high"), down.bitwiseXOR(F.xxhash64(high, r, seed).bitwiseAND(low_mask)).alias("low")))

    def feistel(x: Column) -> Column:
        first = F.struct(F.call_function("shiftright", x, low).alias("high"), x.bitwiseAND(low_mask).alias("low"))
        return F.aggregate(
            F.lit(list(range(rounds))), first, step, lambda p: F.call_function("shiftleft", p["high"], low).bitwiseOR(p["low"])
        )

    def ended(x: Column) -> Column:
        return F.when(x < size, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))

    once = feistel(index.cast("bigint"))
    walked = F.aggregate(F.lit(list(range(WALKS))), once, lambda x, _: F.when(x >= size, feistel(x)).otherwise(x), ended)
    return F.coalesce(walked, F.lit(-1).cast("bigint"))  # never null, so that a join need not work it out once more to ask

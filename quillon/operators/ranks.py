"""Exact places, percentiles and digests of groups of any size.

No window and no list here holds a whole group: values are cut into ranges by approximate quantiles (exact bounds are not
needed, only that ranges are of a bounded size), ranges are summed, and each is then ordered on its own after the sum
of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in a range, about, and the most ranges there are.
ROWS_PER_RANGE, MAX_RANGES = 500_000, 1024
#: Keys in a block of a digest.
BLOCK = 1 << 16


def _bounds(rows: DataFrame, value: Column) -> list[float]:
    """Upper bounds of the ranges but the last: none for small tables."""
    ranges = min(MAX_RANGES, rows.count() // ROWS_PER_RANGE)
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    return sorted({b for b in rows.agg(F.percentile_approx(value.cast("double"), shares, 10 * ranges)).first()[0] or [] if b is not None})


def _range(value: Column, bounds: list[float], low: int = 0, high: int | None = None) -> Column:
    """Number of the range of a value, by halving; nulls go with the last."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value.cast("double") <= bounds[middle], _range(value, bounds, low, middle)).otherwise(_range(value, bounds, middle + 1, high))


def numbered(rows: DataFrame, value: Column, order: list[Column], out: str) -> DataFrame:
    """Add `out`: the place from 0 of each row in the order of `value` (a number), then of `order`."""
    ranged = rows.withColumn("__range", _range(value, _bounds(rows, value)))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(value, *order)) - 1
    return ranged.withColumn("__own", own).join(starts, "__range").withColumn(out, (F.col("__start") + F.col("__own")).cast("bigint")).drop("__range", "__own", "__start")


def at_ranks(rows: DataFrame, group: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """group, n and, by name, the value at a place (from 0, a column over n) of the group's sorted values. Nulls do not count."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    ranged = counted.withColumn("range", _range(F.col(value), _bounds(counted, F.col(value))))
    every, before = W.partitionBy(*group), W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "range").agg(F.sum("c").alias("s"))
    sums = sums.select(*group, "range", F.sum("s").over(every).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    upto = F.sum("c").over(W.partitionBy(*group, "range").orderBy(value))
    reached = ranged.withColumn("own", upto).join(sums, [*group, "range"]).withColumn("upto", F.col("start") + F.col("own"))
    return reached.groupBy(*group, "n").agg(*[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in wanted.items()])


def nearest_ranks(rows: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """p<percent> per group: item round(p * (n - 1)) of the sorted values, halves to even."""
    wanted = {f"p{p}": F.bround(F.lit(p / 100.0) * (F.col("n") - 1)) for p in percents}
    return at_ranks(rows, group, value, wanted).drop("n")


def linear_percentiles(rows: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """p<percent> per group: between the two values around place p * (n - 1), in proportion."""
    at = {p: F.lit(p / 100.0) * (F.col("n") - 1) for p in percents}
    found = at_ranks(rows, group, value, {f"{end}{p}": f(at[p]) for p in percents for end, f in (("low", F.floor), ("high", F.ceil))})
    return found.select(*group, *[(F.col(f"low{p}") + (F.col(f"high{p}") - F.col(f"low{p}")) * (at[p] - F.floor(at[p]))).alias(f"p{p}") for p in percents])


def tree_hash(rows: DataFrame, group: list[str], key: str, record: Column) -> DataFrame:
    """group and digest (SHA-256) of the records in the order of `key` (a whole number): that of the digests of blocks of keys, one a
    line, each of them that of its records, one a line."""
    blocks = rows.select(*group, F.floor(F.col(key) / BLOCK).alias("block"), F.struct(F.col(key).alias("k"), record.alias("r")).alias("x"))

    def digest(of: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["r"]), "\n"), 256)

    by_block = blocks.groupBy(*group, "block").agg(digest("x").alias("r")).withColumn("x", F.struct(F.col("block").alias("k"), "r"))
    return by_block.groupBy(*group).agg(digest("x").alias("digest"))

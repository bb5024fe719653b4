"""Ordered operators expressed as windows: last rows, islands, running budgets, decay, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    nth = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def last_n(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The last `n` rows of each group, numbered oldest first in `place`."""
    back = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(order)))
    place = F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1
    return rows.withColumn("__back", back).where(F.col("__back") <= n).drop("__back").withColumn("place", place.cast("bigint"))


def aged_rounds(rows: DataFrame, keep: int, chars: int) -> DataFrame:
    """Texts of tool rounds (runs of rows with `tool`) older than the last `keep` rounds, cut to `chars`."""
    own = W.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("tool") & ~F.coalesce(F.lag("tool").over(own), F.lit(False)), 1).otherwise(0)
    counted = rows.withColumn("new", new).withColumn("round_no", F.sum("new").over(own)).withColumn("rounds", F.sum("new").over(W.partitionBy("conv_id")))
    aged = F.col("tool") & (F.col("rounds") - F.col("round_no") >= keep)
    return counted.select("conv_id", "turn", F.when(aged, F.substring("text", 1, chars)).otherwise(F.col("text")).alias("text"), aged.alias("aged"))


def equal_share(rows: DataFrame, group: list[str], text: str, cap: int) -> DataFrame:
    """Texts of a group of more than `cap` characters, each cut to cap div (their number)."""
    own = W.partitionBy(*group)
    total, n = F.sum(F.length(text)).over(own), F.count("*").over(own)
    cut = F.substr(text, F.lit(1), F.floor(F.lit(cap) / n).cast("int"))
    return rows.withColumn("__total", total).withColumn("__cut", cut).withColumn(text, F.when(F.col("__total") > cap, F.col("__cut")).otherwise(F.col(text))).drop("__total", "__cut")


def merged_spans(spans: DataFrame, group: list[str], gap: int) -> DataFrame:
    """Spans (start, end) of a group joined where they overlap or lie at most `gap` apart."""
    own = W.partitionBy(*group).orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") - before > gap), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("island", F.sum("new").over(own))
    return numbered.groupBy(*group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"))


def decayed_share(events: DataFrame, group: list[str], value: Column, half_life: float) -> DataFrame:
    """Exponentially decayed mean of `value` per group as of its last event: the closed form of an ordered fold."""
    ends = events.groupBy(*group).agg(F.max("t").alias("t_end"))
    weight = F.pow(F.lit(0.5), (F.col("t_end") - F.col("t")) / half_life)
    return events.join(ends, group).groupBy(*group).agg(F.round(F.sum(weight * value) / F.sum(weight), 6).alias("duty"))


def within_budget(rows: DataFrame, group: str, order: list, size: Column, budget: int, cap_by: str, cap: int) -> DataFrame:
    """Rows in order until the budget breaks, at most `cap` of each `cap_by`; the first one always comes in."""
    nth = F.row_number().over(W.partitionBy(group, cap_by).orderBy(*order))
    kept = rows.withColumn("__nth", nth).where(F.col("__nth") <= cap).drop("__nth").withColumn("__size", size)
    own = W.partitionBy(group).orderBy(*order)
    used = F.sum("__size").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = kept.withColumn("used", used).withColumn("place", (F.row_number().over(own) - 1).cast("bigint"))
    return placed.where((F.col("used") <= budget) | (F.col("place") == 0)).drop("__size")

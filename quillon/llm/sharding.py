"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Law `rows`: row number r goes to place p = permutation(r), shard p mod n, slot p div n. Counts of shards differ by
one at most, slots are gapless, and both follow from the row number alone.

Defined cases: a null text counts as none (size 1, CRC of the empty string); null doc_ids are numbered like any other
value; rows that are equal in doc_id and text are interchangeable; an empty table gives no rows; further columns of
the input are carried along when asked for, whatever their names, except the added ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import packed, permuted, running_start, text_or_empty


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Global row numbers from 0 in a fixed order, without any task that sees all rows."""
    return running_start(df.withColumn("__one", F.lit(1).cast("bigint")), df.count(), [], order, "__one", out).drop("__one")


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 11, keep: bool = False) -> DataFrame:
    """shard and slot of each row of `docs`, with size and text_crc32; with `keep`, the columns of `docs` before them."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_or_empty(F.col("text"))
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    ident = docs.select(
        *([packed(docs.drop(*added), "__row")] if keep else []),
        F.col("doc_id"),
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("__id"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.xxhash64(text).alias("__hash"),
    )
    narrow = ident.drop("__row") if keep else ident
    total = narrow.select("__id").count()
    ordered = running_start(
        ident.withColumn("__one", F.lit(1).cast("bigint")), total, [], ["__id", "__hash"], "__one", "__number"
    )
    place = permuted(F.col("__number"), F.lit(max(total, 1)).cast("bigint"), F.lit(seed))
    out = ordered.withColumn("__place", place)
    shown = [
        "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ]
    return out.select("__row.*" if keep else "doc_id", *shown)

"""Structured Streaming jobs: incremental index, event reducer, windowed stage monitor (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import search

FORMAT = "v1"


def incremental_index(articles: DataFrame, path: str, checkpoint: str, depth: int = 3) -> None:
    """Index what has come since the last run. Each micro-batch owns a folder by its number, written anew when it is repeated,
    so that a restart neither loses nor doubles articles. Another depth or format starts another index."""
    home = f"{path}/{FORMAT}-{depth}"

    def write(batch: DataFrame, number: int) -> None:
        search.postings(batch).write.mode("overwrite").parquet(f"{home}/batch={number}")

    query = articles.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{FORMAT}-{depth}").trigger(availableNow=True).start()
    query.awaitTermination()


def read_index(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{FORMAT}-{depth}").parquet(f"{path}/{FORMAT}-{depth}/batch=*").drop("batch")


STATE = "kept string, cards long, status string"
OUT = "conv_id long, text string, cards long, status string"


def _reduced(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Answer events of one conversation: tokens append, reset clears, a final text replaces, merging sources extend, done and
    error end it (an error keeps what there is)."""
    text, cards, status = state.get if state.exists else ("", 0, "open")
    for frame in rows:
        for r in frame.sort_values("seq").itertuples():
            if status == "done":
                break
            if r.event == "token":
                text += r.data
            elif r.event == "reset":
                text = ""
            elif r.event == "final":
                text = r.data
            elif r.event == "sources":
                cards = cards + int(r.n) if r.merge else int(r.n)
            elif r.event in ("done", "error"):
                status = r.event
    state.update((text, cards, status))
    yield pd.DataFrame([(key[0], text, cards, status)], columns=["conv_id", "text", "cards", "status"])


def reduce_events(events: DataFrame) -> DataFrame:
    """State of each conversation after its events so far (conv_id, seq, event, data, n, merge)."""
    return events.groupBy("conv_id").applyInPandasWithState(_reduced, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def stage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest duration of each stage by event-time window; events later than `late` are let go."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by_window = timed.groupBy(F.window("at", width).alias("w"), "event_type")
    return by_window.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max("value").alias("max_ms")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean_ms", "max_ms")

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.operators import ingest, metrics
from quillon.sources import feeds, judged, sinks, snapshots

KEY = "id string, query string"


def test_snapshot_is_whole_or_absent(spark, tmp_path):
    snapshots.register(spark)
    path = str(tmp_path / "s")
    rows = spark.range(40).select(F.col("id").cast("string"), F.concat(F.lit("q"), "id").alias("query")).repartition(3)
    rows.write.format("snapshot").mode("append").save(path)

    def read():
        return spark.read.format("snapshot").schema(KEY).load(path)

    assert sorted(map(tuple, read().collect())) == sorted((str(i), f"q{i}") for i in range(40)) and read().rdd.getNumPartitions() == 3
    before = sorted(os.listdir(path))
    bad = rows.withColumn("query", F.when(F.col("id") == "39", F.raise_error(F.lit("lost"))).otherwise(F.col("query")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("snapshot").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == before and read().count() == 40  # a failed task leaves nothing
    rows.limit(5).write.format("snapshot").mode("overwrite").save(path)
    assert read().count() == 5 and len(os.listdir(path)) == 2
    file = next(f for f in os.listdir(path) if f != snapshots.MANIFEST)
    with open(f"{path}/{file}", "a") as f:
        f.write("{}")
    with pytest.raises(Exception, match="checksum"):
        read().collect()
    (tmp_path / "s" / snapshots.MANIFEST).write_text(json.dumps({"format": "other", "files": []}))
    with pytest.raises(Exception, match="not a quillon"):
        read().collect()
    (tmp_path / "s" / snapshots.MANIFEST).write_text(json.dumps({"format": snapshots.FORMAT, "files": []}))
    with pytest.raises(Exception, match="without questions"):
        read().collect()
    os.unlink(tmp_path / "s" / snapshots.MANIFEST)
    with pytest.raises(Exception, match="no whole snapshot"):
        read().collect()


def test_a_task_that_outlives_its_write_leaves_nothing(tmp_path):
    home = tmp_path / "s"
    kept = snapshots.SnapshotWriter(str(home), False)
    kept.commit([kept.write(iter([Row(id="1", query="q")]))])
    before = sorted(os.listdir(home))
    late, failed = snapshots.SnapshotWriter(str(home), True), snapshots.SnapshotWriter(str(home), True)

    def slow(writer):
        yield Row(id="2", query="r")
        writer.abort([])  # the driver gives up while the task is at work
        yield Row(id="3", query="s")

    failed.write(slow(failed))
    late.abort([])
    for writer in (kept, late):  # of a second attempt, after the commit; and of a killed task that only begins after the abort
        with pytest.raises(FileNotFoundError):
            writer.write(iter([Row(id="4", query="t")]))
    assert sorted(os.listdir(home)) == before and len(before) == 2


def test_slices_are_read_a_file_to_a_partition(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.yaml").write_text(f"name: s{i}\nentries:\n- {{id: a{i}, query: q}}\n- {{id: b{i}, query: r, slice: own, expected_paths: [A/x]}}\n")
    rows = feeds.golden_slices(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    assert {(r.id, r.slice) for r in rows.collect()} == {(f"{x}{i}", f"s{i}" if x == "a" else "own") for i in range(3) for x in "ab"}


def test_judge_cache_is_read_as_it_lies(spark, tmp_path):
    cache = judged.JudgeCache(spark, "judged_test", str(tmp_path / "cache"), buckets=4)
    keys = spark.range(100).select(F.col("id"), judged.cache_key(F.lit("v1"), F.col("id"), F.lit(None)).alias("cache_key"))
    cache.put(keys.where("id < 60").select("cache_key", F.lit("correct").alias("outcome")))
    assert cache.get(keys).where("cached = 'correct'").count() == 60
    cache.put(keys.where("id >= 30 and id < 40").select("cache_key", F.lit("wrong").alias("outcome")))
    found = {r.id: r.cached for r in cache.get(keys).collect()}
    assert found == {i: None if i >= 60 else "wrong" if 30 <= i < 40 else "correct" for i in range(100)}
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = cache.get(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.sql("drop table judged_test")
    side = plan[plan.index("FileScan") - 600 :] if "FileScan" in plan else ""
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and side, plan  # of the batch alone


def test_prune_writes_only_partitions_with_old_runs(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = spark.createDataFrame([(i, i // 10, f"t{i}" if i % 7 else None, i // 50) for i in range(200)], "id int, run_id int, trace string, part int")
    rows.repartition(1).write.partitionBy("part").parquet(path)
    runs = spark.createDataFrame([(r, f"2024-01-{r + 1:02}") for r in range(20)], "run_id int, started_at string").select("run_id", F.to_timestamp("started_at").alias("started_at"))
    now = F.to_timestamp(F.lit("2024-01-21"))

    def files():
        return {(d, f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}

    before = files()
    assert sinks.prune_traces(spark, path, runs, 0, now) == sinks.prune_traces(spark, path, runs, -3, now) == sinks.prune_traces(spark, path, runs, 90, now) == 0 and files() == before
    n = sinks.prune_traces(spark, path, runs, 14, now)  # runs 0 to 5
    assert n == sum(1 for i in range(60) if i % 7)
    after = files()
    assert {k for k in before if k in after} == {k for k in before if k[0].endswith(("part=2", "part=3"))}
    left = {r.id: r.trace for r in spark.read.parquet(path).collect()}
    assert left == {i: f"t{i}" if i >= 60 and i % 7 else None for i in range(200)}


def test_samples_try_a_bounded_number(spark):
    rows = spark.createDataFrame([(1, i, i % 40 == 0) for i in range(400)] + [(2, i, True) for i in range(3)] + [(3, 0, False)], "zim int, id long, good boolean")
    found = ingest.samples(rows, "zim", "id", F.col("good"), 6, 1).collect()
    assert 0 < sum(r.zim == 1 for r in found) < 6  # of 48 tried, some
    assert sorted(r.id for r in found if r.zim == 2) == [0, 1, 2] and all(r.good for r in found)
    one = {r.zim: r.good for r in ingest.random_entry(rows, "zim", "id", F.col("good"), 1, articles_only=True).collect()}
    assert one == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError, match="not 1 to 24"):
        ingest.samples(rows, "zim", "id", F.col("good"), 25, 1)


def test_source_scores(spark):
    got = spark.createDataFrame([(1, 0, "x"), (1, 1, "alt"), (1, 2, "a"), (2, 0, "y")], "item_id long, place int, path string")
    gold = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "alt", False), (2, "z", True), (3, "q", False), (4, "r", True)], "item_id long, path string, required boolean")
    found = {r.item_id: (r.n_required, r.hit_rank, r.coverage, round(r.reciprocal_rank, 3), round(r.precision, 3)) for r in metrics.source_scores(got, gold).collect()}
    assert found == {1: (2, 3, 0.5, 0.333, 0.667), 2: (1, None, 0.0, 0.0, 0.0), 3: (0, None, 0.0, 0.0, 0.0), 4: (1, None, 0.0, 0.0, 0.0)}
    summary = metrics.source_summary(metrics.source_scores(got, gold)).first()
    assert summary.n == 3 and summary.recall_5 == round(1 / 3, 6) and summary.recall_1 == 0
    assert metrics.source_summary(metrics.source_scores(got, gold).limit(0)).first().mrr == 0


def test_timer_writes_the_progress_that_waits():
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

    from quillon.streaming.job_state import Jobs

    class Held:
        def __init__(self, value):
            self.value = value

        def exists(self):
            return True

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    jobs = Jobs()
    jobs.state, jobs.recent = Held(("running", 1.0, 7.5, 2000, 1000, 1, 0)), Held([(3,)])
    assert list(jobs.handleExpiredTimer((5,), None, ExpiredTimerInfo(1999))) == []
    [out] = jobs.handleExpiredTimer((5,), None, ExpiredTimerInfo(2000))
    assert out.to_dict("records") == [{"job_id": 5, "status": "running", "progress": 7.5, "writes": 2, "dropped": 0, "recent": [3]}]
    assert jobs.state.value == ("running", 7.5, None, None, 2000, 2, 0)


def test_first_events_of_the_clock_are_not_late(spark, tmp_path):
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillon.plans import registry
    from tests.test_queries import SQL, check

    names = ["job_progress", "recovered_jobs"]
    start = datetime(2024, 1, 1)
    #: Job and milliseconds of the job clock; job 4 has a timer that is due with the last event, job 5 begins before the clock.
    events = [(5, -40.5), (1, 0.0), (4, 0.0), (2, 0.5), (1, 0.9), (3, 1.0), (4, 300.0), (1, 500.0), (2, 900.0), (5, 959.4), (3, 1000.0)]
    rows = [(n, start + timedelta(milliseconds=ms * 30000), job, "view", float(n), "{}") for n, (job, ms) in enumerate(events)]
    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.table([pa.array(c) for c in zip(*rows, strict=True)], columns), tmp_path / "events.parquet")
    assert [check(spark, registry.queries()[n], SQL[n], tmp_path) for n in names] == [5, 5]

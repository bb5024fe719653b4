"""Queries over streaming jobs: what they leave when all input has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.plans.search import DOCS, POSTINGS
from quillon.sources.tables import articles, folder, table
from quillon.streaming import job_state, jobs


def streamed(spark, path, like):
    return spark.readStream.schema(like.schema).parquet(path)


@query("ST5", "ST4", sql=f"WITH {DOCS}, {POSTINGS} SELECT zim_id, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM post GROUP BY zim_id")
def stream_incremental_index(spark, sf_dir):
    """Index articles in two runs of a stream, as they would arrive, and sum up the index."""
    home, rows = folder(spark), articles(spark, sf_dir)
    for part in (0, 1):
        rows.where(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(f"{home}/in")
        jobs.incremental_index(streamed(spark, f"{home}/in", rows), f"{home}/index", f"{home}/checkpoint")
    return jobs.read_index(spark, f"{home}/index").groupBy("zim_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


@query("ST2", sql="""SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant' AND turn > u), '') AS text, CAST(max(u) AS BIGINT) AS cards, 'done' AS status
FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS u FROM conversations) GROUP BY conv_id""")
def stream_event_reducer(spark, sf_dir):
    """Conversations as answer events: a user turn resets and names its number of cards, an assistant turn is a token."""
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    no = F.lit(None).cast("string")

    def event(part, when, name, data, n):
        return turns.where(when).select("conv_id", (F.col("turn") * 4 + part).alias("seq"), F.lit(name).alias("event"), data.alias("data"), n.cast("bigint").alias("n"), F.lit(False).alias("merge"))

    rows = event(0, user, "reset", no, F.lit(0)).unionByName(event(1, user, "sources", no, F.col("turn"))).unionByName(event(2, F.col("role") == "assistant", "token", F.col("text"), F.lit(0)))
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("t")).select("conv_id", (F.col("t") * 4 + 3).alias("seq"), F.lit("done").alias("event"), no.alias("data"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("merge"))
    home = folder(spark)
    rows.unionByName(ends).write.parquet(f"{home}/in")
    name = f"reduced_{uuid.uuid4().hex}"
    stream = jobs.reduce_events(streamed(spark, f"{home}/in", rows))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{home}/{name}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{home}/{name}/batch=*")
    return last.select("conv_id", "text", "cards", "status")


@query("AG11", sql="""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1, 2""")
def stream_stage_window(spark, sf_dir):
    """Hourly windows over events, read as a stream (an extension: the watermark lets every event of the table in)."""
    home, rows = folder(spark), table(spark, sf_dir, "events")
    rows.write.parquet(f"{home}/in")
    windows = jobs.stage_windows(streamed(spark, f"{home}/in", rows), late="3650 days")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out/batch=*").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: The job event that an event of the table stands for.
JOB_EVENT = """CASE WHEN event_type = 'signup' THEN 'submit' WHEN event_type = 'click' THEN 'pause' WHEN event_type = 'purchase' THEN 'resume'
WHEN event_type = 'view' AND value > 90 THEN 'done' WHEN event_type = 'error' AND value > 90 THEN 'fail' WHEN event_type = 'error' AND value < 0.2 THEN 'cancel'
WHEN event_type = 'error' AND value < 5 THEN 'start' ELSE 'progress' END"""

#: The same states in SQL: one event of every job at a step.
JOB_STATES = f"""WITH RECURSIVE ev AS MATERIALIZED (
  SELECT user_id AS job_id, event_id AS seq, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 30000 // 1000 AS ms, {JOB_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), mark AS (SELECT max(ms) AS last FROM ev), st AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS progress, CAST(NULL AS DOUBLE) AS waiting, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS written, CAST(0 AS BIGINT) AS writes FROM ev
  UNION ALL
  SELECT job_id, n, status, CASE WHEN now THEN w2 ELSE p1 END, CASE WHEN now THEN NULL ELSE w2 END, CASE WHEN now THEN NULL WHEN reported THEN wr1 + 1000 ELSE d1 END, CASE WHEN now THEN ms ELSE wr1 END, k1 + CASE WHEN now THEN 1 ELSE 0 END
  FROM (
    SELECT *, reported AND (wr1 IS NULL OR ms >= wr1 + 1000) OR (status IN ('done', 'failed', 'cancelled') AND w2 IS NOT NULL) AS now FROM (
      SELECT *, event = 'progress' AND status = 'running' AS reported, CASE WHEN event = 'progress' AND status = 'running' THEN value ELSE w1 END AS w2 FROM (
        SELECT job_id, ev.n, event, value, ms,
          CASE WHEN event = 'submit' AND status IS NULL THEN 'queued' WHEN event IN ('start', 'progress') AND (status IS NULL OR status = 'queued') THEN 'running' WHEN event = 'pause' AND status = 'running' THEN 'paused'
            WHEN event = 'resume' AND status = 'paused' THEN 'queued' WHEN event = 'cancel' THEN 'cancelled' WHEN event = 'done' AND status IN ('queued', 'running') THEN 'done'
            WHEN event = 'fail' AND status IN ('queued', 'running') THEN 'failed' ELSE status END AS status,
          CASE WHEN due <= ms THEN waiting ELSE progress END AS p1, CASE WHEN due <= ms THEN NULL ELSE waiting END AS w1, CASE WHEN due <= ms THEN NULL ELSE due END AS d1,
          CASE WHEN due <= ms THEN due ELSE written END AS wr1, writes + CASE WHEN due <= ms THEN 1 ELSE 0 END AS k1
        FROM st JOIN ev USING (job_id) WHERE ev.n = st.n + 1 AND (status IS NULL OR status NOT IN ('done', 'failed', 'cancelled')))))
), ends AS (
  SELECT job_id, max(n) AS n, arg_max(status, n) AS status, arg_max(writes, n) + max(CASE WHEN flush THEN 1 ELSE 0 END) AS writes,
    arg_max(CASE WHEN flush THEN waiting WHEN progress IS NULL THEN -1 ELSE progress END, n) AS progress
  FROM (SELECT *, waiting IS NOT NULL AND due <= last AND n = max(n) OVER (PARTITION BY job_id) AS flush FROM st, mark) GROUP BY job_id
)"""


def _job_states(spark, sf_dir):
    """The state of every job when all events of the table have been read, at one second for each eight hours."""
    home, events = folder(spark), table(spark, sf_dir, "events")
    # The clock starts at that day, not at 1970: a stream's first watermark is 1970, and what is not after a watermark is let go as late.
    start = "CAST('2024-01-01' AS TIMESTAMP)"
    at = F.expr(f"timestamp_millis(unix_millis({start}) + (unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros({start})) div 30000 div 1000)")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), at.alias("at"), F.expr(JOB_EVENT).alias("event"), "value")
    rows.write.parquet(f"{home}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch, number):
        batch.withColumn("no", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    try:
        states = job_state.job_states(streamed(spark, f"{home}/in", rows))
        states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    every = spark.read.parquet(f"{home}/out/batch=*")
    return every.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "writes", "dropped", "recent"), F.struct("no", "writes")).alias("s")).select("job_id", "s.*")


@query("ST3", "ST4", "ST8", sql=JOB_STATES + """
SELECT e.job_id, e.status, round(CASE WHEN e.progress < 0 THEN NULL ELSE e.progress END, 6) AS progress, CAST(e.writes AS BIGINT) AS writes, CAST(greatest(e.n - 64, 0) AS BIGINT) AS dropped, f.seq AS oldest, l.seq AS newest
FROM ends e JOIN ev f ON f.job_id = e.job_id AND f.n = greatest(e.n - 64, 0) + 1 JOIN ev l ON l.job_id = e.job_id AND l.n = e.n""")
def job_progress(spark, sf_dir):
    """Jobs by their events, with throttled writes of progress and the last 64 events of each."""
    return _job_states(spark, sf_dir).select(
        "job_id", "status", F.round("progress", 6).alias("progress"), "writes", "dropped", F.get("recent", 0).alias("oldest"), F.element_at("recent", -1).alias("newest"))


@query("ST7", sql=JOB_STATES + " SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'queued' ELSE status END AS status FROM ends")
def recovered_jobs(spark, sf_dir):
    """Jobs after a restart: running and queued ones are queued again, paused and ended ones stay."""
    return _job_states(spark, sf_dir).select("job_id", job_state.recovered(F.col("status")).alias("status"))

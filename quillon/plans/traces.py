"""Queries over stage traces."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import ranks, windows
from quillon.plans.registry import query
from quillon.sources.tables import stages, table


@query("AG9", "AG11", sql="""SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type
UNION ALL SELECT 'total', count(*), round(quantile_cont(t, 0.5), 6), round(quantile_cont(t, 0.95), 6) FROM (SELECT sum(value) AS t FROM events GROUP BY user_id)""")
def latency_percentiles_linear(spark, sf_dir):
    rows = stages(spark, sf_dir).select("stage", "run_id", "duration_ms")
    totals = rows.groupBy("run_id").agg(F.sum("duration_ms").alias("duration_ms")).select(F.lit("total").alias("stage"), "duration_ms")
    both = rows.select("stage", "duration_ms").unionByName(totals)
    found = ranks.linear_percentiles(both, ["stage"], "duration_ms", [50, 95])
    return both.groupBy("stage").agg(F.count("*").alias("n")).join(found, "stage").select("stage", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("AG10", "AG12", sql="""SELECT event_type AS stage, count(*) AS count, round(avg(value), 6) AS mean_ms, round(list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS p95_ms FROM events GROUP BY event_type""")
def latency_nearest_rank(spark, sf_dir):
    rows = stages(spark, sf_dir)
    sums = rows.groupBy("stage").agg(F.count("*").alias("count"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    p95 = ranks.nearest_ranks(rows, ["stage"], "duration_ms", [95])
    return sums.join(p95, "stage").select("stage", "count", "mean_ms", F.round("p95", 6).alias("p95_ms"))


@query("AG13", sql="SELECT event_type AS stage, row_number() OVER (ORDER BY min(event_id)) - 1 AS place FROM events GROUP BY event_type")
def components_first_seen(spark, sf_dir):
    first = stages(spark, sf_dir).groupBy("stage").agg(F.min("seq").alias("seq"))
    return first.select("stage", (F.row_number().over(W.orderBy("seq")) - 1).cast("bigint").alias("place"))


@query("WN11", sql="""WITH e AS (SELECT user_id, epoch(ts) AS t, value > 50 AS on_duty FROM events), z AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS t_end FROM e)
SELECT user_id, round(sum(pow(0.5, (t_end - t) / 86400.0) * CASE WHEN on_duty THEN 1.0 ELSE 0.0 END) / sum(pow(0.5, (t_end - t) / 86400.0)), 6) AS duty FROM z GROUP BY user_id""")
def duty_cycle_decay(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return windows.decayed_share(rows.withColumn("t", F.col("us") / 1e6), ["user_id"], (F.col("value") > 50).cast("double"), 86400.0)


@query("WN10", sql="""WITH e AS (SELECT user_id, event_id, epoch(ts) AS t, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done,
  min(epoch(ts)) OVER (PARTITION BY user_id) AS t0 FROM events)
SELECT event_id, round(done / (t - t0), 9) AS rate, CAST(floor((total - done) / (done / (t - t0))) AS BIGINT) AS eta FROM e WHERE t > t0""")
def throughput_eta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    own = W.partitionBy("user_id")
    counted = rows.withColumn("total", F.count("*").over(own)).withColumn("t0", F.min("t").over(own)).withColumn("done", F.row_number().over(own.orderBy("ts", "event_id")))
    rate = F.col("done") / (F.col("t") - F.col("t0"))
    return counted.where("t > t0").select("event_id", F.round(rate, 9).alias("rate"), F.floor((F.col("total") - F.col("done")) / rate).cast("bigint").alias("eta"))


@query("WN13", sql="""WITH s AS (SELECT user_id, event_id % 5000 AS start, event_id % 5000 + CAST(floor(value) AS BIGINT) AS "end" FROM events),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", count(*) AS parts FROM i GROUP BY user_id, island""")
def span_merge_islands(spark, sf_dir):
    start = F.col("event_id") % 5000
    spans = table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.floor("value")).alias("end"))
    return windows.merged_spans(spans, ["user_id"], 200)


@query("WN14", sql="""SELECT event_id, round(median(CASE WHEN value > 20 THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM events""")
def rolling_median_rate(spark, sf_dir):
    own = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.percentile(F.when(F.col("value") > 20, F.col("value")), 0.5).over(own), 6).alias("rate"))


@query("ST13", sql="SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def newest_run_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("event_type"))


@query("ST2", "ST12", sql="""WITH e AS (SELECT user_id, event_id, event_type, value, ts FROM events), types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS no FROM (SELECT DISTINCT event_type FROM events)),
k AS (SELECT e.*, no FROM e JOIN types USING (event_type)), r AS (SELECT *, max(CASE WHEN no = 1 THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM k)
SELECT user_id, count(*) FILTER (WHERE no <> 1 AND event_id > coalesce(reset, -1)) AS kept, count(*) FILTER (WHERE no = 1) AS resets, count(*) AS seen FROM r GROUP BY user_id""")
def event_reducer_after_reset(spark, sf_dir):
    """The batch form of the event reducer: what came after the last reset counts."""
    rows = table(spark, sf_dir, "events")
    reset_type = rows.agg(F.min("event_type").alias("reset_type"))
    marked = rows.join(F.broadcast(reset_type)).withColumn("is_reset", F.col("event_type") == F.col("reset_type"))
    last = F.max(F.when(F.col("is_reset"), F.col("event_id"))).over(W.partitionBy("user_id"))
    kept = marked.withColumn("last", last)
    return kept.groupBy("user_id").agg(
        F.count_if(~F.col("is_reset") & (F.col("event_id") > F.coalesce("last", F.lit(-1)))).alias("kept"), F.count_if("is_reset").alias("resets"), F.count("*").alias("seen"))


@query("MA10", sql="""SELECT event_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY THEN props END AS props FROM events""")
def trace_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    newest = rows.agg((F.max("ts") - F.expr("interval 10 days")).alias("cutoff"))
    return rows.join(F.broadcast(newest)).select("event_id", F.when(F.col("ts") >= F.col("cutoff"), F.col("props")).alias("props"))


@query("MA15", "FI16", "MA18", sql="SELECT event_id, coalesce(json_extract_string(props, '$.a.k'), json_extract_string(props, '$.a_k'), json_extract_string(props, '$.k')) AS v FROM events")
def json_dotted_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(*[F.get_json_object("props", p) for p in ("$.a.k", "$.a_k", "$.k")]).alias("v"))

"""Evaluation metrics: ranking, answers, attribution, tokens, latency, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranks


def share(condition: Column, of: Column | None = None) -> Column:
    """Share of rows (or of rows where `of` holds) that meet a condition; 0 when there are none."""
    if of is None:
        return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))
    return F.coalesce(F.avg(F.when(of, condition.cast("double"))), F.lit(0.0))


def hit_ranks(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """item_id and rank (from 1, null for a miss) of each item that expects anything: its first retrieved expected path."""
    key = F.regexp_replace(F.trim("path"), "^A/", "").alias("key")
    hits = retrieved.select("item_id", "rank", key).join(expected.select("item_id", key).distinct(), ["item_id", "key"])
    first = hits.groupBy("item_id").agg((F.min("rank") + 1).alias("rank"))
    return expected.select("item_id").distinct().join(first, "item_id", "left")


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """Recall at 1, 5, 10, 20, nDCG at 10 and MRR by slice and over all (slice `all`), in one pass of grouping sets."""
    rank = F.col("rank")
    ndcg = F.when(rank <= 10, F.ln(F.lit(2.0)) / F.ln(rank + 1.0)).otherwise(0.0)
    aggs = [F.count("*").alias("n")]
    aggs += [F.round(share(F.coalesce(rank <= k, F.lit(False))), 6).alias(f"recall_{k}") for k in (1, 5, 10, 20)]
    aggs += [F.round(F.avg(F.coalesce(ndcg, F.lit(0.0))), 6).alias("ndcg_10"), F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr")]
    return ranks.groupingSets([["slice"], []], "slice").agg(*aggs).withColumn("slice", F.coalesce("slice", F.lit("all")))


def answer_columns() -> list[Column]:
    """Aggregates over rows (verdict, expected_behavior, abstained, quality, toxic as sub-facts)."""
    verdict, asked = F.col("verdict"), F.col("expected_behavior") == "answer"
    judged = verdict != "unjudged"
    abstained = F.col("abstained")
    return [
        F.count("*").alias("n"), F.round(share(verdict == "correct"), 6).alias("strict_accuracy"),
        F.round(F.avg(F.when(verdict == "correct", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)), 6).alias("weighted_accuracy"),
        F.round(F.coalesce(F.avg(F.when(judged, (F.col("quality") + 1 - F.col("toxic")) / 2.0)), F.lit(0.0)), 6).alias("sub_fact_coverage"),
        F.round(share(abstained, asked), 6).alias("over_refusal"), F.round(share(~abstained, ~asked), 6).alias("hallucination_rate"),
        F.round(share(F.when(asked, ~abstained).otherwise(abstained)), 6).alias("abstention_correctness"),
        F.count_if(~judged).alias("unjudged"), (F.count_if(~judged) == 0).alias("complete"),
    ]


def attribution_columns() -> list[Column]:
    """The 2 x 2 of (correct, failed) by (source found, missed) over judged answers with a source to find."""
    counted = (F.col("verdict") != "unjudged") & (F.col("capability") != "out_of_corpus")
    correct, found = F.col("verdict") == "correct", F.col("hit_rank").isNotNull()
    return [
        F.count_if(counted & correct & found).alias("correct_source_found"), F.count_if(counted & correct & ~found).alias("correct_source_missed"),
        F.count_if(counted & ~correct & found).alias("failed_source_found"), F.count_if(counted & ~correct & ~found).alias("failed_source_missed"),
    ]


def source_columns() -> list[Column]:
    eligible, rank = F.col("capability") != "out_of_corpus", F.col("hit_rank")
    out = [F.count_if(eligible).alias("n_eligible")]
    out += [F.round(share(F.coalesce(rank <= k, F.lit(False)), eligible), 6).alias(f"recall_{k}") for k in (1, 5, 10, 20)]
    return [*out, F.round(F.coalesce(F.avg(F.when(eligible, F.coalesce(1.0 / rank, F.lit(0.0)))), F.lit(0.0)), 6).alias("mrr")]


def reference_points(rows: DataFrame, model: str) -> DataFrame:
    """Ceiling, floor and system over rows with an oracle (oracle, closed_book, verdict, oracle_model), and the headroom realised.

    Headroom is suppressed, with a reason, without oracle or answer model, when models differ, or when floor tops ceiling."""
    has = F.col("oracle").isNotNull()
    sums = rows.agg(
        F.count_if(has & (F.col("oracle") == "correct")).alias("ceiling"), F.count_if(has & (F.col("closed_book") == "correct")).alias("floor"),
        F.count_if(has & (F.col("verdict") == "correct")).alias("system"), F.count("*").alias("total"), F.count_if(has).alias("reference_n"),
        F.count_if(has & (F.col("closed_book") == "correct") & (F.col("verdict") != "correct")).alias("regressions"),
        F.collect_set(F.when(has, F.col("oracle_model"))).alias("models"),
    )
    room = F.col("ceiling") - F.col("floor")
    reason = (
        F.when(F.size("models") == 0, "no oracle").when(F.lit(model) == "", "no answer model")
        .when(~((F.size("models") == 1) & F.array_contains("models", model)), "models differ").when(room < 0, "floor exceeds ceiling").otherwise("")
    )
    realised = F.when(room > 0, (F.col("system") - F.col("floor")) / room).otherwise(F.when(F.col("system") >= F.col("ceiling"), 1.0).otherwise(0.0))
    return sums.withColumn("reason", reason).withColumn("headroom", F.when(F.col("reason") == "", F.round(realised, 6))).drop("models")


def token_usage(rows: DataFrame, group: str) -> DataFrame:
    """Per group and over all (`all`), of rows with input and output tokens a and b: n, sums, and the floors of the medians of a + b, a
    and b."""
    every = rows.withColumn("ab", F.col("a") + F.col("b")).withColumn("g", F.explode(F.array(F.col(group), F.lit("all"))))
    out = every.groupBy("g").agg(F.count("*").alias("n"), F.sum("a").alias("total_input"), F.sum("b").alias("total_output"), F.sum("ab").alias("total"))
    for column, name in (("ab", "p50"), ("a", "p50_input"), ("b", "p50_output")):
        median = ranks.linear_percentiles(every, ["g"], column, [50])
        out = out.join(median.select("g", F.floor("p50").cast("bigint").alias(name)), "g")
    return out.withColumnRenamed("g", group)


def content_hash(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """content_hash: 16 hex digits over all rows in key order, whatever order they come in."""
    record = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    return ranks.tree_hash(rows, [], key, record).select(F.substring("digest", 1, 16).alias("content_hash"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id and bucket of each question of either run (question_id, verdict): a full outer join."""
    both = a.select("question_id", F.col("verdict").alias("va")).join(b.select("question_id", F.col("verdict").alias("vb")), "question_id", "full_outer")
    va, vb = F.col("va"), F.col("vb")
    bucket = (
        F.when(vb.isNull(), "only_a").when(va.isNull(), "only_b").when((va == "unjudged") | (vb == "unjudged"), "unjudged")
        .when((va == "correct") & (vb == "correct"), "both_correct").when(vb == "correct", "fixed").when(va == "correct", "broken").otherwise("both_wrong")
    )
    return both.select("question_id", bucket.alias("bucket"))


def sign_test(first: DataFrame) -> DataFrame:
    """Two-sided exact sign test over discordant pairs (wins, losses): min(1, 2 * sum of C(n, i) / 2^n for i up to the lesser).

    Log-binomials come from running sums of logs, which stay exact enough for any count."""
    n, k = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    logs = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))), lambda i: F.log((n - i + 1) / i))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    tail = F.aggregate(logs, start, lambda s, x: F.struct((s["log"] + x).alias("log"), (s["sum"] + F.exp(s["log"] + x)).alias("sum")), lambda s: s["sum"])
    value = F.when(n == 0, 1.0).when(k == 0, F.least(F.lit(1.0), 2 * F.pow(F.lit(0.5), n))).otherwise(F.least(F.lit(1.0), 2 * tail))
    return first.withColumn("p_value", F.round(value, 6))


def source_scores(retrieved: DataFrame, sources: DataFrame) -> DataFrame:
    """Per question with sources (item_id, path, required; others are alternatives): n_required, hit_rank (1-based place of the first required
    source in what was retrieved, null for a miss), coverage (share of the required ones found), reciprocal_rank, and precision (share of
    what was retrieved that is any source; 0 where nothing was). `retrieved` has item_id, place (from 0) and path."""
    gold = sources.groupBy("item_id", "path").agg(F.max("required").alias("required"))
    asked = gold.groupBy("item_id").agg(F.count_if("required").alias("n_required"))
    got = retrieved.groupBy("item_id").agg(F.count("*").alias("n_retrieved"))
    hits = retrieved.join(gold, ["item_id", "path"]).groupBy("item_id").agg(
        F.min(F.when(F.col("required"), F.col("place") + 1)).alias("hit_rank"), F.count_distinct(F.when(F.col("required"), F.col("path"))).alias("n_found"), F.count("*").alias("n_gold"))
    rows = asked.join(got, "item_id", "left").join(hits, "item_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "item_id", "n_required", "hit_rank", F.when(F.col("n_required") > 0, F.coalesce(F.col("n_found") / F.col("n_required"), zero)).otherwise(zero).alias("coverage"),
        F.coalesce(1 / F.col("hit_rank"), zero).alias("reciprocal_rank"), F.coalesce(F.col("n_gold") / F.col("n_retrieved"), zero).alias("precision"))


def source_summary(scores: DataFrame) -> DataFrame:
    """One row: n, recall_1, _5, _10 and _20, coverage, mrr and precision over the questions with a required source; zeros without any."""
    own = scores.where("n_required > 0")
    recalls = [F.round(F.coalesce(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f"recall_{k}") for k in (1, 5, 10, 20)]
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in (("coverage", "coverage"), ("reciprocal_rank", "mrr"), ("precision", "precision"))]
    return own.agg(F.count("*").alias("n"), *recalls, *means)

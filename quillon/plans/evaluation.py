"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answers as metrics_of_runs
from quillon.operators import metrics, patterns, ranking, ranks, search
from quillon.plans.ranking import FUSED
from quillon.plans.registry import query
from quillon.plans.search import BASE, CANDIDATES, asked, candidates
from quillon.sources.tables import articles, questions, small, table, verdicts

V = """v AS (
  SELECT doc_id AS question_id, CASE lang WHEN 'es' THEN 'out_of_corpus' ELSE lang END AS capability, source AS slice,
    CASE WHEN quality IS NULL THEN 'unjudged' WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'incorrect' END AS verdict,
    doc_id % 7 = 0 AS abstained, n_chars, text, quality, toxic, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 + 1 END AS hit_rank,
    CASE lang WHEN 'es' THEN 'abstain' ELSE 'answer' END AS expected_behavior
  FROM documents LEFT JOIN labels USING (doc_id))"""
ANSWER = """count(*) AS n, round(avg(CASE WHEN verdict = 'correct' THEN 1.0 ELSE 0 END), 6) AS strict_accuracy,
  round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END), 6) AS weighted_accuracy,
  round(coalesce(avg((quality + 1 - toxic) / 2.0) FILTER (WHERE verdict <> 'unjudged'), 0), 6) AS sub_fact_coverage,
  round(coalesce(avg(CASE WHEN abstained THEN 1.0 ELSE 0 END) FILTER (WHERE expected_behavior = 'answer'), 0), 6) AS over_refusal,
  round(coalesce(avg(CASE WHEN NOT abstained THEN 1.0 ELSE 0 END) FILTER (WHERE expected_behavior = 'abstain'), 0), 6) AS hallucination_rate,
  round(avg(CASE WHEN abstained = (expected_behavior = 'abstain') THEN 1.0 ELSE 0 END), 6) AS abstention_correctness,
  count(*) FILTER (WHERE verdict = 'unjudged') AS unjudged, count(*) FILTER (WHERE verdict = 'unjudged') = 0 AS complete"""
COUNTED = "verdict <> 'unjudged' AND capability <> 'out_of_corpus'"
ATTRIBUTION = f"""count(*) FILTER (WHERE {COUNTED} AND verdict = 'correct' AND hit_rank IS NOT NULL) AS correct_source_found,
  count(*) FILTER (WHERE {COUNTED} AND verdict = 'correct' AND hit_rank IS NULL) AS correct_source_missed,
  count(*) FILTER (WHERE {COUNTED} AND verdict <> 'correct' AND hit_rank IS NOT NULL) AS failed_source_found,
  count(*) FILTER (WHERE {COUNTED} AND verdict <> 'correct' AND hit_rank IS NULL) AS failed_source_missed"""
SOURCE = "count(*) FILTER (WHERE capability <> 'out_of_corpus') AS n_eligible, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN hit_rank <= {k} THEN 1.0 ELSE 0 END) FILTER (WHERE capability <> 'out_of_corpus'), 0), 6) AS recall_{k}" for k in (1, 5, 10, 20)
) + ", round(coalesce(avg(coalesce(1.0 / hit_rank, 0)) FILTER (WHERE capability <> 'out_of_corpus'), 0), 6) AS mrr"
EXPECTED = "expected AS (SELECT item_id, zim_id, path FROM fts JOIN items USING (item_id) JOIN docs USING (zim_id, path) WHERE contains(text, passage))"
RANKED = """ranked AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, zim_id, path) - 1 AS rank FROM fused)"""
RANKS = f"""{BASE}, {CANDIDATES}, {FUSED}, {EXPECTED}, {RANKED},
ranks AS (SELECT item_id, 'slice_' || item_id % 4 AS slice, min(rank) + 1 AS rank FROM (SELECT DISTINCT item_id, path FROM expected) LEFT JOIN ranked USING (item_id, path) GROUP BY item_id)"""


def answers(spark, sf_dir):
    return verdicts(spark, sf_dir).withColumn("expected_behavior", F.when(F.col("capability") == "out_of_corpus", "abstain").otherwise("answer"))


def expected(spark, sf_dir):
    """item_id and path of the articles that hold an item's passage: sought among those that have all of its terms."""
    found = search.matches(asked(spark, sf_dir), articles(spark, sf_dir)).select("item_id", "zim_id", "path")
    passages = questions(spark, sf_dir).select("item_id", "passage")
    rows = articles(spark, sf_dir).select("zim_id", "path", "text").join(small(found), ["zim_id", "path"]).join(small(passages), "item_id")
    return rows.where(F.contains("text", F.col("passage"))).select("item_id", "path")


@query("JN10", "AG8", "EV1", sql=f"""{RANKS}
SELECT coalesce(slice, 'all') AS slice, count(*) AS n, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}" for k in (1, 5, 10, 20))},
  round(avg(CASE WHEN rank <= 10 THEN ln(2.0) / ln(rank + 1.0) ELSE 0 END), 6) AS ndcg_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM ranks GROUP BY GROUPING SETS ((slice), ())""")
def ranking_metrics_by_slice(spark, sf_dir):
    retrieved = ranking.reciprocal_rank(candidates(spark, sf_dir))
    places = metrics.hit_ranks(retrieved, expected(spark, sf_dir))
    return metrics.ranking_metrics(places.withColumn("slice", F.concat(F.lit("slice_"), (F.col("item_id") % 4).cast("string"))))


@query("FI8", sql=f"{BASE}, {CANDIDATES}, {EXPECTED} SELECT DISTINCT item_id FROM expected")
def recall_eligible(spark, sf_dir):
    return expected(spark, sf_dir).select("item_id").distinct()


@query("AG24", "SE4", sql=f"""{BASE}, {CANDIDATES}, {EXPECTED},
arms AS (SELECT 'fts' AS arm, item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY rank, zim_id, path) AS r FROM fts WHERE rank < 40
  UNION ALL SELECT 'any', item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY rank, zim_id, path) FROM anyt WHERE rank < 5),
hits AS (SELECT arm, item_id, min(r) AS r FROM arms JOIN expected USING (item_id, path) GROUP BY arm, item_id),
grid AS (SELECT item_id, arm FROM (SELECT DISTINCT item_id FROM expected), (SELECT unnest(['fts', 'any']) AS arm)),
full_grid AS (SELECT arm, item_id, r FROM grid LEFT JOIN hits USING (item_id, arm))
SELECT arm, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
  round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall_any,
  count(*) FILTER (WHERE r IS NOT NULL AND item_id NOT IN (SELECT item_id FROM hits h WHERE h.arm <> full_grid.arm)) AS only_here
FROM full_grid GROUP BY arm""")
def recall_arms_rescued_lost(spark, sf_dir):
    own = candidates(spark, sf_dir)
    arms = ranking.restart_ranks(own.withColumnRenamed("rank", "r").withColumnRenamed("source", "arm"), ["item_id", "arm"], ["r", "zim_id", "path"])
    gold = expected(spark, sf_dir)
    hits = arms.join(gold, ["item_id", "path"]).groupBy("item_id").pivot("arm", ["fts", "any"]).agg(F.min("rank") + 1)
    grid = gold.select("item_id").distinct().join(hits, "item_id", "left")
    by_arm = grid.select(F.explode(F.array(
        F.struct(F.lit("fts").alias("arm"), F.col("fts").alias("r"), F.col("any").alias("other")), F.struct(F.lit("any").alias("arm"), F.col("any").alias("r"), F.col("fts").alias("other"))
    )).alias("a")).select("a.*")
    near = lambda k: F.round(metrics.share(F.coalesce(F.col("r") <= k, F.lit(False))), 6)
    return by_arm.groupBy("arm").agg(
        F.count("*").alias("n"), near(1).alias("recall_1"), near(10).alias("recall_10"), F.round(metrics.share(F.col("r").isNotNull()), 6).alias("recall_any"),
        F.count_if(F.col("r").isNotNull() & F.col("other").isNull()).alias("only_here"),
    )


@query("AG16", sql=f"WITH {V} SELECT {ANSWER} FROM v")
def answer_metrics(spark, sf_dir):
    return answers(spark, sf_dir).agg(*metrics.answer_columns())


#: Sources of a question: the documents that hold its first forty characters, case aside; the first two by number are required, others alternatives. For every
#: fourth question none is required. What is retrieved: its candidates, best rank first.
SOURCES = f"""{BASE}, {CANDIDATES},
holds AS (SELECT item_id, path, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS nth FROM benchmark b JOIN docs d ON contains(lower(d.text), lower(left(b.text, 40)))),
gold AS (SELECT item_id, path, nth <= 2 AND item_id % 4 > 0 AS required FROM holds),
best AS (SELECT item_id, path, min(rank) AS rank FROM cand GROUP BY ALL),
retrieved AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY rank, path) AS place FROM best),
hits AS (SELECT item_id, min(place) FILTER (WHERE required) AS hit_rank, count(*) FILTER (WHERE required) AS found, count(*) AS gold_got FROM retrieved JOIN gold USING (item_id, path) GROUP BY item_id),
scores AS (
  SELECT item_id, n_required, hit_rank, CASE WHEN n_required > 0 THEN coalesce(found, 0) / n_required ELSE 0 END AS coverage, coalesce(1 / hit_rank, 0) AS rr, coalesce(gold_got / n, 0) AS precision
  FROM (SELECT item_id, count(*) FILTER (WHERE required) AS n_required FROM gold GROUP BY item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM retrieved GROUP BY item_id) USING (item_id) LEFT JOIN hits USING (item_id))"""


def _source_scores(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.left("text", F.lit(40))).alias("pattern")).where("pattern <> ''")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    holds = patterns.held(texts, items).join(items, "pattern")
    nth = F.row_number().over(W.partitionBy("item_id").orderBy("doc_id"))
    gold = holds.withColumn("nth", nth).select("item_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), ((F.col("nth") <= 2) & (F.col("item_id") % 4 > 0)).alias("required"))
    best = candidates(spark, sf_dir).groupBy("item_id", "path").agg(F.min("rank").alias("rank"))
    retrieved = best.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("rank", "path")) - 1)
    return metrics.source_scores(retrieved, gold)


@query("AG14", sql=SOURCES + " SELECT item_id, n_required, hit_rank, round(coverage, 6) AS coverage, round(rr, 6) AS reciprocal_rank, round(precision, 6) AS precision FROM scores")
def source_metrics(spark, sf_dir):
    """Source metrics of each question: what its candidates find of its required and alternative sources."""
    rows = _source_scores(spark, sf_dir)
    return rows.select("item_id", "n_required", F.col("hit_rank").cast("bigint").alias("hit_rank"), *[F.round(c, 6).alias(c) for c in ("coverage", "reciprocal_rank", "precision")])


@query("AG15", sql=SOURCES + " SELECT count(*) AS n, " + ", ".join(f"round(coalesce(avg(CASE WHEN hit_rank <= {k} THEN 1.0 ELSE 0 END), 0), 6) AS recall_{k}" for k in (1, 5, 10, 20)) + """,
round(coalesce(avg(coverage), 0), 6) AS coverage, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(precision), 0), 6) AS precision FROM scores WHERE n_required > 0""")
def source_summary(spark, sf_dir):
    """The same over the questions with a required source."""
    return metrics.source_summary(_source_scores(spark, sf_dir))


@query("AG18", sql=f"WITH {V} SELECT {ATTRIBUTION} FROM v")
def attribution_matrix(spark, sf_dir):
    return answers(spark, sf_dir).agg(*metrics.attribution_columns())


@query("AG19", sql=f"WITH {V} SELECT coalesce(capability, 'all') AS capability, {ANSWER}, {SOURCE}, {ATTRIBUTION} FROM v GROUP BY CUBE (capability)")
def by_capability_cube(spark, sf_dir):
    columns = [*metrics.answer_columns(), *metrics.source_columns(), *metrics.attribution_columns()]
    return answers(spark, sf_dir).cube("capability").agg(*columns).withColumn("capability", F.coalesce("capability", F.lit("all")))


@query("AG25", sql=f"""WITH {V} SELECT coalesce(capability, '*') AS capability, coalesce(slice, '*') AS slice, coalesce(expected_behavior, '*') AS behavior, count(*) AS n
FROM v GROUP BY GROUPING SETS ((capability), (slice), (expected_behavior), ())""")
def dataset_composition(spark, sf_dir):
    sets = answers(spark, sf_dir).groupingSets([["capability"], ["slice"], ["expected_behavior"], []], "capability", "slice", "expected_behavior")
    every = F.lit("*")
    return sets.agg(F.count("*").alias("n")).select(
        F.coalesce("capability", every).alias("capability"), F.coalesce("slice", every).alias("slice"), F.coalesce("expected_behavior", every).alias("behavior"), "n"
    )


POINTS = "points AS (SELECT *, CASE WHEN question_id % 4 <> 3 THEN CASE WHEN question_id % 5 < 4 THEN 'correct' ELSE 'incorrect' END END AS oracle, CASE WHEN question_id % 6 = 0 THEN 'correct' ELSE 'incorrect' END AS closed_book FROM v)"


@query("AG17", sql=f"""WITH {V}, {POINTS}, s AS (
  SELECT count(*) FILTER (WHERE oracle = 'correct') AS ceiling, count(*) FILTER (WHERE oracle IS NOT NULL AND closed_book = 'correct') AS floor,
    count(*) FILTER (WHERE oracle IS NOT NULL AND verdict = 'correct') AS system, count(*) AS total, count(oracle) AS reference_n,
    count(*) FILTER (WHERE oracle IS NOT NULL AND closed_book = 'correct' AND verdict <> 'correct') AS regressions FROM points)
SELECT *, CASE WHEN floor > ceiling THEN 'floor exceeds ceiling' ELSE '' END AS reason,
  CASE WHEN ceiling > floor THEN round((system - floor) / (ceiling - floor), 6) WHEN ceiling = floor THEN CASE WHEN system >= ceiling THEN 1.0 ELSE 0.0 END END AS headroom FROM s""")
def reference_points_headroom(spark, sf_dir):
    number = F.col("question_id")
    rows = answers(spark, sf_dir).withColumn("oracle", F.when(number % 4 != 3, F.when(number % 5 < 4, "correct").otherwise("incorrect"))).withColumn(
        "closed_book", F.when(number % 6 == 0, "correct").otherwise("incorrect")).withColumn("oracle_model", F.lit("m1"))
    return metrics.reference_points(rows, "m1")


@query("AG20", sql=f"""WITH {V}, t AS (SELECT capability, n_chars AS a, n_chars // 3 AS b FROM v) SELECT coalesce(capability, 'all') AS capability, count(*) AS n,
  CAST(sum(a) AS BIGINT) AS total_input, CAST(sum(b) AS BIGINT) AS total_output, CAST(sum(a + b) AS BIGINT) AS total, CAST(floor(quantile_cont(a + b, 0.5)) AS BIGINT) AS p50,
  CAST(floor(quantile_cont(a, 0.5)) AS BIGINT) AS p50_input, CAST(floor(quantile_cont(b, 0.5)) AS BIGINT) AS p50_output FROM t GROUP BY ROLLUP (capability)""")
def token_usage_medians(spark, sf_dir):
    rows = answers(spark, sf_dir).select("capability", F.col("n_chars").alias("a"), F.floor(F.col("n_chars") / 3).alias("b"))
    return metrics.token_usage(rows, "capability")


def _nearest(values: str, percent: int) -> str:
    return f"list_sort({values})[CAST(round_even({percent} / 100.0 * (len({values}) - 1), 0) AS BIGINT) + 1]"


@query("AG21", "AG10", sql=f"""WITH {V}, p AS (SELECT capability, list(n_chars) AS peaks, count(*) AS n, max(n_chars) AS max, count(*) FILTER (WHERE n_chars > 8192) AS over_8192,
  count(*) FILTER (WHERE n_chars > 16384) AS over_16384, CAST(sum(question_id % 4 + 1) AS BIGINT) AS requests_total FROM v GROUP BY capability)
SELECT capability, n, {_nearest("peaks", 50)} AS p50, {_nearest("peaks", 90)} AS p90, {_nearest("peaks", 95)} AS p95, max, over_8192, over_16384, requests_total FROM p""")
def peak_context(spark, sf_dir):
    size, rows = F.col("n_chars"), answers(spark, sf_dir)
    sums = rows.groupBy("capability").agg(
        F.count("*").alias("n"), F.max(size).alias("max"), F.count_if(size > 8192).alias("over_8192"), F.count_if(size > 16384).alias("over_16384"),
        F.sum(F.col("question_id") % 4 + 1).alias("requests_total"),
    )
    return sums.join(ranks.nearest_ranks(rows, ["capability"], "n_chars", [50, 90, 95]), "capability")


@query("AG23", "EV4", sql="SELECT count(*) AS n, round(coalesce(corr(quality, 1 - toxic), 0), 6) AS pearson FROM labels")
def pearson_calibration(spark, sf_dir):
    judged = table(spark, sf_dir, "labels")
    return judged.agg(F.count("*").alias("n"), F.round(F.coalesce(F.nanvl(F.corr(F.col("quality").cast("double"), 1.0 - F.col("toxic")), F.lit(0.0)), F.lit(0.0)), 6).alias("pearson"))


@query("AG26", "AG27", sql="""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS wins, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS losses FROM labels),
t AS (SELECT wins, losses, unnest(range(0, least(wins, losses) + 1)) AS i FROM c)
SELECT wins, losses, round(least(1.0, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0)))), 6) AS p_value FROM t GROUP BY wins, losses""")
def sign_test_pairs(spark, sf_dir):
    judged = table(spark, sf_dir, "labels")
    wins = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("wins")
    return metrics.sign_test(judged.agg(wins, F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("losses")))


@query("AG34", "AG35", sql="""WITH g AS (SELECT avg(CASE WHEN doc_id % 2 = 0 THEN quality END) AS candidate, avg(CASE WHEN doc_id % 2 = 1 THEN quality END) AS baseline, avg(quality) AS ceiling, avg(toxic) AS floor FROM labels)
SELECT round(candidate - baseline, 6) AS delta, candidate - baseline >= -0.02 AS gate_passed, ceiling >= 0.85 AND floor <= 0.20 AS verified FROM g""")
def regression_gate(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    g = table(spark, sf_dir, "labels").agg(
        F.avg(F.when(even, F.col("quality"))).alias("c"), F.avg(F.when(~even, F.col("quality"))).alias("b"), F.avg("quality").alias("ceiling"), F.avg("toxic").alias("floor"))
    return g.select(F.round(F.col("c") - F.col("b"), 6).alias("delta"), (F.col("c") - F.col("b") >= -0.02).alias("gate_passed"), ((F.col("ceiling") >= 0.85) & (F.col("floor") <= 0.20)).alias("verified"))


@query("AG28", sql=rf"""{BASE}, {CANDIDATES},
keys AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(passage), '[a-z0-9]+'), lambda t: length(t) >= 4 AND NOT contains(lower(raw), t))) AS keys FROM items),
pre AS (SELECT item_id, path FROM cand WHERE source = 'fts' AND rank < 2), every AS (SELECT DISTINCT item_id, path FROM cand),
met AS (SELECT every.item_id, pre.path IS NOT NULL AS seeded, lower(text) AS t FROM every LEFT JOIN pre USING (item_id, path) JOIN docs ON docs.path = every.path),
best AS (SELECT item_id, seeded, max(len(list_filter(keys, lambda k: contains(t, k))) / len(keys)) AS f FROM met JOIN keys USING (item_id) WHERE len(keys) > 0 GROUP BY ALL),
wide AS (SELECT item_id, max(f) FILTER (WHERE seeded) AS pre, max(f) AS every FROM best GROUP BY item_id)
SELECT item_id, CASE WHEN len(keys) = 0 THEN NULL WHEN pre >= 0.999 THEN 'A' WHEN every >= 0.999 THEN 'B' WHEN every >= 0.7 THEN 'C' ELSE 'D' END AS tier FROM keys LEFT JOIN wide USING (item_id)""")
def evidence_tiers(spark, sf_dir):
    """How much of an answer's distinctive tokens some candidate article holds: in the first ones (A), in any (B), mostly (C), or not (D)."""
    items = questions(spark, sf_dir)
    long = F.regexp_extract_all(F.lower("passage"), F.lit("[a-z0-9]+"), F.lit(0))
    keys = items.select("item_id", F.array_distinct(F.filter(long, lambda t: (F.length(t) >= 4) & ~F.contains(F.lower("raw"), t))).alias("keys"))
    own = candidates(spark, sf_dir).groupBy("item_id", "path").agg(F.bool_or((F.col("source") == "fts") & (F.col("rank") < 2)).alias("seeded"))
    met = articles(spark, sf_dir).select("path", F.lower("text").alias("t")).join(small(own), "path").join(small(keys.where(F.size("keys") > 0)), "item_id")
    part = F.size(F.filter("keys", lambda k: F.contains("t", k))) / F.size("keys")
    wide = met.groupBy("item_id").agg(F.max(F.when(F.col("seeded"), part)).alias("pre"), F.max(part).alias("every"))
    tier = F.when(F.size("keys") == 0, None).when(F.col("pre") >= 0.999, "A").when(F.col("every") >= 0.999, "B").when(F.col("every") >= 0.7, "C").otherwise("D")
    return keys.join(wide, "item_id", "left").select("item_id", tier.alias("tier"))


@query("AG29", "FI13", sql=r"""SELECT role, count(*) AS n, round(avg(CASE WHEN regexp_matches(text, '(?i)\b(?:could not find|no mention|not mentioned|cannot find)\b') OR trim(text) = '' THEN 1.0 ELSE 0 END), 6) AS not_found,
  round(avg(CASE WHEN regexp_matches(text, '\[[0-9]+\]') THEN 1.0 ELSE 0 END), 6) AS cited, round(avg(CASE WHEN regexp_matches(text, '[0-9]+ ?[-+*/=] ?[0-9]+') THEN 1.0 ELSE 0 END), 6) AS arithmetic
FROM conversations GROUP BY role""")
def answer_shape_rates(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.round(metrics.share(T.looks_abstained(text)), 6).alias("not_found"), F.round(metrics.share(text.rlike(r"\[[0-9]+\]")), 6).alias("cited"),
        F.round(metrics.share(text.rlike("[0-9]+ ?[-+*/=] ?[0-9]+")), 6).alias("arithmetic"))


@query("AG32", sql="""SELECT substr(sha256(string_agg(d, chr(10) ORDER BY b)), 1, 16) AS content_hash FROM (SELECT item_id // 65536 AS b, sha256(string_agg(sha256(concat_ws(chr(31), CAST(item_id AS VARCHAR), text)), chr(10) ORDER BY item_id)) AS d FROM benchmark GROUP BY 1)""")
def content_hash_canonical(spark, sf_dir):
    return metrics.content_hash(table(spark, sf_dir, "benchmark"), "item_id", ["item_id", "text"])


@query("JN19", sql=f"""{BASE}, {CANDIDATES}, {FUSED}, {EXPECTED}, {RANKED}, hit AS (SELECT e.item_id, min(rank) AS r FROM expected e LEFT JOIN ranked USING (item_id, path) GROUP BY e.item_id)
SELECT CAST(n AS BIGINT) AS top_n, count(*) AS items, count(*) FILTER (WHERE r < n) AS covered FROM hit, (SELECT unnest([6, 4, 3, 2]) AS n) GROUP BY n""")
def gold_in_top_n(spark, sf_dir):
    places = metrics.hit_ranks(ranking.reciprocal_rank(candidates(spark, sf_dir)), expected(spark, sf_dir))
    tops = places.select("rank", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (6, 4, 3, 2)])).alias("top_n"))
    return tops.groupBy("top_n").agg(F.count("*").alias("items"), F.count_if(F.col("rank") <= F.col("top_n")).alias("covered"))


#: Questions of a run: the documents of a source, with what each used.
AUDITED = """a AS (SELECT source AS run_id, CASE WHEN quality IS NULL THEN 'unjudged' WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'incorrect' END AS verdict, doc_id % 7 = 0 AS abstained,
n_chars AS input_tokens, n_chars % 97 AS output_tokens, CAST(n_chars * 3 AS DOUBLE) AS latency_ms, n_chars * 5 AS peak, n_chars % 4 + 1 AS requests, CAST(n_chars > 5000 AS INTEGER) AS overflows, n_chars % 4 = 0 AS first_only,
CAST(n_chars % 11 = 0 AS INTEGER) AS blocked, CAST(n_chars % 10 AS DOUBLE) / 10 AS sub_facts FROM documents LEFT JOIN labels USING (doc_id))"""


@query("AG37", sql=f"""WITH {AUDITED} SELECT run_id, count(*) AS n, count(*) FILTER (WHERE requests = 1) AS one_request, count(*) FILTER (WHERE first_only) AS first_only, round(quantile_cont(peak::DOUBLE, 0.5)) AS peak_p50,
round(quantile_cont(peak::DOUBLE, 0.95)) AS peak_p95, max(peak) AS peak_max, count(*) FILTER (WHERE peak > 8192) AS over_8192, CAST(sum(overflows) AS BIGINT) AS overflows,
round(count(*) FILTER (WHERE verdict = 'correct') / count(*), 4) AS strict, count(*) FILTER (WHERE verdict <> 'unjudged') AS judged, count(*) FILTER (WHERE abstained AND verdict = 'incorrect') AS over_refusal,
CAST(sum(input_tokens) AS BIGINT) AS input_sum, max(requests) AS requests_max, round(avg(requests), 2) AS requests_mean, count(*) FILTER (WHERE blocked > 0) AS blocked_questions, round(avg(latency_ms) / 1000, 1) AS latency_mean_s,
(SELECT string_agg(requests || ':' || c, ',' ORDER BY requests) FROM (SELECT run_id AS r, requests, count(*) AS c FROM a GROUP BY ALL) WHERE r = a.run_id) AS requests_histogram FROM a GROUP BY run_id""")
def run_audit(spark, sf_dir):
    """The audit of each run: context peaks, requests, verdicts, refusals, tokens and latency."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    verdict = F.when(F.col("quality").isNull(), "unjudged").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").otherwise("incorrect")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("run_id"), verdict.alias("verdict"), (F.col("doc_id") % 7 == 0).alias("abstained"), n.alias("input_tokens"), (n % 97).alias("output_tokens"), (n * 3).cast("double").alias("latency_ms"),
        (n * 5).alias("peak"), (n % 4 + 1).alias("requests"), (n > 5000).cast("int").alias("overflows"), (n % 4 == 0).alias("first_only"), (n % 11 == 0).cast("int").alias("blocked"), ((n % 10).cast("double") / 10).alias("sub_facts"))
    found = metrics_of_runs.run_audit(rows)
    names = "run_id n one_request first_only peak_p50 peak_p95 peak_max over_8192 overflows strict judged over_refusal input_sum requests_max requests_mean blocked_questions latency_mean_s requests_histogram"
    return found.select(*names.split())

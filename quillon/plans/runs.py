"""Queries over runs, conversations, settings and logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import metrics, ranks, windows
from quillon.plans.evaluation import V, answers
from quillon.plans.registry import query
from quillon.sources.tables import table

RUN_A = "a AS (SELECT question_id, verdict FROM v WHERE question_id % 10 <> 9)"
RUN_B = "b AS (SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'correct' ELSE verdict END AS verdict FROM v WHERE question_id % 10 <> 8)"
BUCKETED = f"""WITH {V}, {RUN_A}, {RUN_B}, c AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, CASE
  WHEN b.verdict IS NULL THEN 'only_a' WHEN a.verdict IS NULL THEN 'only_b' WHEN 'unjudged' IN (a.verdict, b.verdict) THEN 'unjudged'
  WHEN a.verdict = 'correct' AND b.verdict = 'correct' THEN 'both_correct' WHEN b.verdict = 'correct' THEN 'fixed' WHEN a.verdict = 'correct' THEN 'broken'
  ELSE 'both_wrong' END AS bucket FROM a FULL OUTER JOIN b ON a.question_id = b.question_id)"""


def two_runs(spark, sf_dir):
    v = answers(spark, sf_dir)
    number = F.col("question_id")
    a = v.where(number % 10 != 9).select("question_id", "verdict")
    b = v.where(number % 10 != 8).select("question_id", F.when(number % 3 == 0, "correct").otherwise(F.col("verdict")).alias("verdict"))
    return a, b


@query("JN8", sql=f"""{BUCKETED}, d AS (SELECT bucket, question_id // 65536 AS b, count(*) AS n, sha256(string_agg(CAST(question_id AS VARCHAR), chr(10) ORDER BY question_id)) AS d FROM c GROUP BY 1, 2)
SELECT bucket, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS ids_sha256 FROM d GROUP BY bucket""")
def compare_runs_buckets(spark, sf_dir):
    rows = metrics.compare_runs(*two_runs(spark, sf_dir))
    digests = ranks.tree_hash(rows, ["bucket"], "question_id", F.col("question_id").cast("string")).withColumnRenamed("digest", "ids_sha256")
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(digests, "bucket")


@query("JN9", sql="""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 7 + 1 AS new_rank, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 7 + 1 END AS old_rank FROM orders)
SELECT CASE WHEN new_rank < coalesce(old_rank, 1000) THEN 'win' WHEN new_rank > coalesce(old_rank, 1000) THEN 'loss' ELSE 'unchanged' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def compare_win_loss(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 + 1).alias("new_rank"))
    old = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7 + 1).alias("old_rank"))
    miss = F.coalesce("old_rank", F.lit(1000))
    outcome = F.when(F.col("new_rank") < miss, "win").when(F.col("new_rank") > miss, "loss").otherwise("unchanged")
    return new.join(old, "id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("FI10", sql=f"""WITH {V}, f AS (SELECT question_id, capability, count(*) OVER () AS total FROM v WHERE verdict IN ('incorrect', 'partial') AND hit_rank IS NULL AND capability <> 'out_of_corpus')
SELECT * FROM f ORDER BY question_id LIMIT 20 OFFSET 5""")
def results_filter_page(spark, sf_dir):
    """A page of one attribution cell with the number of all its rows."""
    found = answers(spark, sf_dir).where("verdict in ('incorrect', 'partial') and hit_rank is null and capability <> 'out_of_corpus'").select("question_id", "capability")
    page = found.orderBy("question_id").offset(5).limit(20)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))), how="inner")


@query("AG22", sql=f"""WITH {V} SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50,
  list_sort(list(n_chars))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 FROM v WHERE n_chars > 0""")
def latency_positive_only(spark, sf_dir):
    rows = answers(spark, sf_dir).where("n_chars > 0").withColumn("run", F.lit("all"))
    sums = rows.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return sums.join(ranks.nearest_ranks(rows, ["run"], "n_chars", [50, 95]), "run").drop("run")


@query("AG31", sql="""SELECT l_returnflag AS run, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS tokens, list_sort(list(l_quantity))[count(*) // 2 + 1] AS p50_upper, round(avg(l_extendedprice), 4) AS mean_latency,
  round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END), 6) AS strict FROM lineitem GROUP BY l_returnflag""")
def model_matrix_rollup(spark, sf_dir):
    """Roll-up by run with the upper median."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "run")
    sums = rows.groupBy("run").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("tokens"), F.round(F.avg("l_extendedprice"), 4).alias("mean_latency"),
        F.round(metrics.share(F.col("l_linestatus") == "F"), 6).alias("strict"))
    median = ranks.at_ranks(rows, ["run"], "l_quantity", {"p50_upper": F.floor(F.col("n") / 2)}).drop("n")
    return sums.join(median, "run").select("run", "n", "tokens", "p50_upper", "mean_latency", "strict")


@query("WN9", sql="""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM r WHERE back <= 4""")
def history_last_n(spark, sf_dir):
    return windows.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 4)


@query("WN12", sql="""WITH t AS (SELECT conv_id, turn, role = 'assistant' AS tool, text FROM conversations),
m AS (SELECT *, CASE WHEN tool AND NOT coalesce(lag(tool) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 1 ELSE 0 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS round_no, sum(new) OVER (PARTITION BY conv_id) AS rounds FROM m)
SELECT conv_id, turn, CASE WHEN tool AND rounds - round_no >= 2 THEN left(text, 80) ELSE text END AS text, tool AND rounds - round_no >= 2 AS aged FROM g""")
def tool_round_aging_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("tool"), "text")
    return windows.aged_rounds(rows, keep=2, chars=80)


@query("TX26", sql=r"""SELECT conv_id, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS title
FROM (SELECT conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE turn = 0)""")
def conversation_titles(spark, sf_dir):
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("…"))).otherwise(t).alias("title"))


@query("TX22", sql=r"""WITH lines AS (SELECT conv_id, turn, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[\n.]') AS ls FROM conversations)),
c AS (SELECT conv_id, turn, pos, trim(regexp_replace(trim(line), '^[-*0-9.)"'' ]+|["'' ]+$', '', 'g')) AS line FROM lines),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(line), '[\p{L}\p{N}_]+')) AS toks FROM c
  WHERE line <> '' AND NOT starts_with(line, '(') AND NOT regexp_matches(line, '(?i)^[qa]:') AND len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) <= 6),
asked AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '[\p{L}\p{N}_]+')) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
j AS (SELECT k.*, len(list_intersect(toks, coalesce(q, []))) AS m, len(coalesce(q, [])) AS nq FROM k LEFT JOIN asked USING (conv_id)),
n AS (SELECT * FROM j WHERE coalesce(m / nullif(len(toks) + nq - m, 0), 0) < 0.75),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, list_sort(toks) ORDER BY pos) AS n FROM n),
o AS (SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nth FROM f WHERE n = 1)
SELECT * FROM o WHERE nth <= 3""")
def reformulation_parse(spark, sf_dir):
    """Other wordings in each turn: up to three short lines that differ from each other and, by at least a quarter of their words, from what was asked."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q")).select("conv_id", T.tokens(F.col("q")).alias("q"))
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"[\n.]")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace(F.trim("line"), r"""^[-*0-9.)"' ]+|["' ]+$""", ""))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    kept = lines.withColumn("line", bare).where((F.col("line") != "") & ~F.startswith("line", F.lit("(")) & ~F.col("line").rlike("(?i)^[qa]:") & (F.size(words) <= 6))
    kept = kept.withColumn("toks", F.array_sort(F.array_distinct(T.tokens(F.col("line"))))).join(asked, "conv_id", "left")
    none = F.array().cast("array<string>")
    kept = kept.where(F.coalesce(T.jaccard(F.col("toks"), F.array_distinct(F.coalesce("q", none))), F.lit(0.0)) < 0.75)
    first = windows.first_of(kept, ["conv_id", "turn", "toks"], ["pos"])
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("pos")).cast("bigint")
    return first.select("conv_id", "turn", "line", nth.alias("nth")).where("nth <= 3")


@query(sql=r"""SELECT doc_id, CAST(n AS BIGINT) AS cited, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{3}([aeiou]+)[a-z]{3}', 1)) AS v FROM documents), (SELECT 1 AS n) WHERE length(v) = 2 GROUP BY 1, 2""")
def citation_like_counts(spark, sf_dir):
    """Marked spans per document: counts of a captured group, as citations are counted."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3}([aeiou]+)[a-z]{3}"), F.lit(1))).alias("v"))
    return found.where(F.length("v") == 2).groupBy("doc_id").agg(F.lit(1).cast("bigint").alias("cited"), F.count("*").alias("times"))


@query("JN15", sql="SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ANTI JOIN (SELECT conv_id FROM conversations WHERE turn >= 4) USING (conv_id)")
def snapshot_missing_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id").distinct().join(rows.where("turn >= 4"), "conv_id", "left_anti")


@query("TX36", sql="""WITH s AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN total > 3000 THEN left(text, CAST(3000 // n AS INTEGER)) ELSE text END AS text FROM s""")
def equal_share_truncation(spark, sf_dir):
    return windows.equal_share(table(spark, sf_dir, "conversations"), ["conv_id"], "text", 3000).select("conv_id", "turn", "text")


@query("RC5", sql="""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 1500""")
def window_fit(spark, sf_dir):
    used = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("used", used).where("used <= 1500").select("conv_id", "turn")


@query("MA7", sql="""SELECT doc_id, CAST(ceil(n_chars / 3) AS BIGINT) AS tokens, CASE WHEN ceil(n_chars / 3) <= 512 THEN '8k' WHEN ceil(n_chars / 3) <= 1024 THEN '16k' ELSE 'full' END AS plan FROM documents""")
def context_plan(spark, sf_dir):
    tokens = F.ceil(F.col("n_chars") / 3)
    return table(spark, sf_dir, "documents").select("doc_id", tokens.cast("bigint").alias("tokens"), F.when(tokens <= 512, "8k").when(tokens <= 1024, "16k").otherwise("full").alias("plan"))


@query("MA13", sql="""WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS db, CASE WHEN event_id % 3 = 0 THEN event_id % 11 END AS env FROM events)
SELECT event_id, coalesce(CASE WHEN db BETWEEN 0 AND 50 THEN db END, env, 5) AS value, CASE WHEN db BETWEEN 0 AND 50 THEN 'db' WHEN env IS NOT NULL THEN 'env' ELSE 'default' END AS layer FROM s""")
def settings_layers(spark, sf_dir):
    """A setting from its layers: the stored value if it is in range, else the environment's, else the default."""
    stored = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("bigint")
    env = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 11)
    rows = table(spark, sf_dir, "events").select("event_id", F.when(stored.between(0, 50), stored).alias("db"), env.alias("env"))
    layer = F.when(F.col("db").isNotNull(), "db").when(F.col("env").isNotNull(), "env").otherwise("default")
    return rows.select("event_id", F.coalesce("db", "env", F.lit(5).cast("bigint")).alias("value"), layer.alias("layer"))


@query("EV3", "AG13", sql=f"""WITH {V}, {RUN_A}, {RUN_B} SELECT (SELECT substr(sha256(string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id)), 1, 16) FROM a)
  = (SELECT substr(sha256(string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id)), 1, 16) FROM b) AS same_subset, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b""")
def compare_guards(spark, sf_dir):
    """Whether two runs answered the same questions; a comparison is refused when they did not."""
    a, b = two_runs(spark, sf_dir)
    one = a.select("question_id", F.lit(1).alias("a")).join(b.select("question_id", F.lit(1).alias("b")), "question_id", "full_outer")
    return one.agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_subset"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("FI14", sql="SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS overflow FROM documents")
def overflow_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 3 == 0, "Request exceeds the Context Size").otherwise("bad request")
    return docs.select("doc_id", T.context_overflow(F.when(F.col("doc_id") % 2 == 0, 400).otherwise(500), body).alias("overflow"))


@query("SC18", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN greatest(n_chars - 5, 0) WHEN 2 THEN 90 END AS first, least(CASE doc_id % 4 WHEN 0 THEN 99 WHEN 3 THEN NULL ELSE n_chars END, n_chars - 1) AS last FROM documents WHERE n_chars > 100 AND doc_id % 4 < 3")
def byte_ranges(spark, sf_dir):
    header = F.get(F.array(F.lit("bytes=10-99"), F.lit("bytes=-5"), F.lit("bytes=90-"), F.lit("lines=1-2")), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").where("n_chars > 100").withColumn("r", T.byte_range(header, F.col("n_chars")))
    return docs.where("r is not null").select("doc_id", "r.first", "r.last")


@query("TX37", sql="SELECT p_partkey, string_agg(CASE WHEN length(w) = 2 THEN NULL ELSE upper(left(w, 1)) || lower(substr(w, 2)) END, ' ' ORDER BY i) AS title FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY p_partkey")
def humanised_titles(spark, sf_dir):
    words = F.filter(F.split("p_type", " "), lambda w: F.length(w) != 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ").alias("title"))

"""Answers: citations and their shares, support by sources, highlights, the audit of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

MARK = r"\[[0-9]+\]"
SCORED = ("correct", "partial", "incorrect")
#: Tokens from which a turn counts as a large one.
LARGE_TURN = 10_000


def citations(answer: Column, cards: Column) -> Column:
    """answer_start, answer_end (characters) and source_index (from 0) of the marks [n] of an answer that name one of its cards."""
    found = F.regexp_extract_all(answer, F.lit(MARK), F.lit(0))
    gaps = F.transform(F.split(answer, MARK, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, mark: F.struct(gap.alias("gap"), mark.alias("mark")))

    def placed(done: Column, pair: Column) -> Column:
        start = F.coalesce(F.get(done, F.size(done) - 1)["answer_end"], F.lit(0)) + pair["gap"]
        number = F.regexp_extract(pair["mark"], "[0-9]+", 0).try_cast("int")
        return F.concat(done, F.array(F.struct(start.alias("answer_start"), (start + F.length(pair["mark"])).alias("answer_end"), (number - 1).alias("source_index"))))

    none = F.array().cast("array<struct<answer_start:int,answer_end:int,source_index:int>>")
    every = F.when(F.size(found) > 0, F.aggregate(pairs, none, placed)).otherwise(none)
    return F.filter(every, lambda s: (s["source_index"] >= 0) & (s["source_index"] < cards))


def cited_cards(answer: Column, cards: Column) -> Column:
    """Numbers (from 1) of the cards that an answer cites, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(citations(answer, cards), lambda s: s["source_index"] + 1)))


def citation_shares(rows: DataFrame) -> DataFrame:
    """Per run_id, of rows (run_id, answer, cards, first_cards: how many cards there were before any tool, tool: whether one was used,
    verdict): questions with tools, those that cite cards of tools, those that cite none, all citations and those of cards of
    tools, and the share of correct answers of either kind."""
    cited = rows.where("tool").withColumn("cited", cited_cards(F.col("answer"), F.col("cards")))
    late = F.size(F.filter("cited", lambda n: n > F.col("first_cards")))
    own = cited.select("run_id", "verdict", F.size("cited").alias("n"), late.alias("late"))
    judged, by_tool = F.col("verdict").isin(*SCORED), F.col("late") > 0

    def correct(group: Column) -> Column:
        return F.round(F.count_if(group & (F.col("verdict") == "correct")) / F.nullif(F.count_if(group & judged), F.lit(0)), 4)

    return own.groupBy("run_id").agg(
        F.count("*").alias("tool_questions"), F.count_if(by_tool).alias("cite_tool_cards"), F.count_if(F.col("n") == 0).alias("no_citations"),
        F.sum("n").cast("bigint").alias("citations"), F.sum("late").cast("bigint").alias("tool_citations"),
        correct(by_tool).alias("correct_with"), correct(~by_tool).alias("correct_without"),
    )


def by_turn_size(rows: DataFrame) -> DataFrame:
    """Per run_id and size of turn (rows: run_id, input_tokens, hit_rank, verdict; unjudged ones left out): n, percent with the wanted
    source among the cards, its mean rank, and percent correct of these."""
    size = F.when(F.coalesce("input_tokens", F.lit(0)) < LARGE_TURN, "<10k").otherwise(">=10k")
    gold = F.col("hit_rank").isNotNull()
    return rows.where("verdict <> 'unjudged'").groupBy("run_id", size.alias("turn_size")).agg(
        F.count("*").alias("n"), F.round(100 * F.count_if(gold) / F.count("*"), 1).alias("gold_in_cards"), F.round(F.avg("hit_rank"), 1).alias("mean_gold_rank"),
        F.round(100 * F.count_if(gold & (F.col("verdict") == "correct")) / F.nullif(F.count_if(gold), F.lit(0)), 1).alias("correct_given_gold"),
    )


def long_tokens(text: Column) -> Column:
    """Different runs of four or more letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))


def supported(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """id and supported of questions (id, answer): whether every required source (id, required, text) shares a long token with the
    answer. An answer without such tokens, or without required sources, is supported."""
    own = questions.select("id", long_tokens(F.col("answer")).alias("own"))
    wanted = sources.where("required").join(own, "id")
    shared = F.arrays_overlap("own", long_tokens(F.coalesce("text", F.lit("")))) | (F.size("own") == 0)
    by_question = wanted.select("id", F.coalesce(shared, F.lit(False)).alias("shared")).groupBy("id").agg(F.bool_and("shared").alias("shared"))
    return own.join(by_question, "id", "left").select("id", F.coalesce("shared", F.lit(True)).alias("supported"))


def highlights(text: Column, query: Column) -> Column:
    """A text in segments (text, mark): those that are words of the query, in any case, are marked."""
    words = F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(T.STOPWORDS))
    pattern = F.concat(F.lit("(?i)("), F.array_join(words, "|"), F.lit(")"))
    cut = F.split(F.regexp_replace(text, pattern, F.lit("\u0001$1\u0001")), "\u0001")
    parts = F.filter(F.transform(cut, lambda p: F.struct(p.alias("text"), F.array_contains(words, F.lower(p)).alias("mark"))), lambda s: s["text"] != "")
    return F.when(F.size(words) > 0, parts).otherwise(F.array(F.struct(text.alias("text"), F.lit(False).alias("mark"))))


def run_audit(rows: DataFrame) -> DataFrame:
    """Audit of each run_id from its questions: verdict, abstained, input_tokens, output_tokens, latency_ms, peak (input tokens), requests,
    overflows, first_only (no stage but the first search), blocked (calls refused), sub_facts (share covered).

    Here a refusal is one too many when the answer is also judged incorrect."""
    judged, correct = F.col("verdict").isin(*SCORED), F.col("verdict") == "correct"

    def at(column: str, *shares: float) -> list[Column]:
        return [F.percentile(F.col(column).cast("double"), F.lit(p)) for p in shares]

    p50, p90, p95 = at("peak", 0.5, 0.9, 0.95)
    counts = [F.count_if(F.col("verdict") == v).cast("string") for v in (*SCORED, "unjudged")]
    sums = rows.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("requests") == 1).alias("one_request"), F.count_if("first_only").alias("first_only"),
        F.round(p50).alias("peak_p50"), F.round(p90).alias("peak_p90"), F.round(p95).alias("peak_p95"), F.max("peak").alias("peak_max"),
        F.count_if(F.col("peak") > 8192).alias("over_8192"), F.count_if(F.col("peak") > 16384).alias("over_16384"), F.sum("overflows").cast("bigint").alias("overflows"),
        F.round(F.count_if(correct) / F.count("*"), 4).alias("strict"), F.concat_ws("/", *counts).alias("verdicts"), F.count_if(judged).alias("judged"),
        F.round(F.coalesce(F.count_if(correct) / F.nullif(F.count_if(judged), F.lit(0)), F.lit(0.0)), 4).alias("strict_judged"),
        F.round(F.avg(F.when(judged, F.col("sub_facts"))), 4).alias("sub_facts"), F.count_if(F.col("abstained") & (F.col("verdict") == "incorrect")).alias("over_refusal"),
        F.round(F.avg("input_tokens")).alias("input_mean"), F.round(at("input_tokens", 0.95)[0]).alias("input_p95"), F.sum("input_tokens").alias("input_sum"),
        F.round(F.avg("output_tokens")).alias("output_mean"), F.round(F.avg("requests"), 2).alias("requests_mean"), F.max("requests").alias("requests_max"),
        F.count_if(F.col("blocked") > 0).alias("blocked_questions"), F.sum("blocked").cast("bigint").alias("blocked"),
        F.round(F.avg("latency_ms") / 1000, 1).alias("latency_mean_s"), F.round(at("latency_ms", 0.95)[0] / 1000, 1).alias("latency_p95_s"),
    )
    by_requests = rows.groupBy("run_id", "requests").agg(F.count("*").alias("c"))
    entry = F.concat_ws(":", F.col("requests").cast("string"), F.col("c").cast("string"))
    histogram = by_requests.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("requests", entry.alias("e")))), lambda s: s["e"]), ",").alias("requests_histogram"))
    return sums.join(histogram, "run_id")

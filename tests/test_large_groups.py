"""Groups larger than a limit, and plans that keep them from meeting in one task."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillon.operators import inverted, search
from quillon.plans import pipeline, registry
from tests.test_queries import check


def written(path, name, **columns):
    pq.write_table(pa.table(columns), path / f"{name}.parquet")


def searched(path):
    """Three archives; one holds 60 articles with all terms of the question, and 30 with some."""
    texts = [f"alpha beta gamma {'delta ' * (i % 7)}" for i in range(60)] + [f"alpha {'epsilon ' * (i % 5)}" for i in range(30)] + ["beta gamma", "alpha beta gamma"]
    sources = ["src1"] * 90 + ["src2", "src3"]
    n = len(texts)
    written(path, "documents", doc_id=list(range(n)), text=texts, lang=["en"] * n, source=sources, n_chars=[len(t) for t in texts])
    written(path, "benchmark", item_id=[0, 1], text=["alpha beta gamma", "epsilon zeta"])


def test_all_matches_come_before_what_is_appended(spark, tmp_path):
    searched(tmp_path)
    assert check(spark, registry.queries()["append_reformulated"], registry.oracle_sql()["append_reformulated"], tmp_path) > 60


def test_candidates_of_large_archives(spark, tmp_path):
    searched(tmp_path)
    for name in ("flat_union_fallback", "rrf_global", "prefix_shorten_retry", "ladder_first_nonempty", "fts_or_of_terms_union"):
        assert check(spark, registry.queries()[name], registry.oracle_sql()[name], tmp_path) > 0


def test_postings_of_an_archive_do_not_meet_in_one_task(spark):
    docs = spark.range(500).select(F.lit(1).alias("zim_id"), F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("alpha beta "), F.col("id") % 9).alias("text"))
    asked = spark.createDataFrame([(1, ["alpha", "beta", "3"])], "item_id long, terms array<string>")
    for every in (False, True):
        found = search.ranked(search.matches(asked, docs, every=every), 5, "item_id", "zim_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, plan
        assert not any(line.split("hashpartitioning(")[1].startswith("zim_id#") and "path#" not in line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line), plan
        assert [r.path for r in found.orderBy("rank").collect()] == ["p102", "p111", "p12", "p120", "p129"]


def test_index_is_written_with_one_shuffle_of_texts(spark, tmp_path):
    docs = spark.range(300).select((F.col("id") % 2).cast("int").alias("zim_id"), F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("alpha beta "), F.col("id") % 9).alias("text"))
    inverted.write_index(docs, str(tmp_path / "index"), buckets=4, block=16)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    written = next(p for p in reversed(plans) if f"{tmp_path}/index" in p and "sort" in p.lower())
    dealt = set(re.findall(r"(?:hash|range)partitioning\([^)]*\)", re.sub(r"#\d+L?", "", written)))
    assert len([d for d in dealt if "ROUND" not in d]) == 1 and "range" in dealt.pop(), dealt
    asked = spark.createDataFrame([(1, ["alpha", "3"])], "item_id long, terms array<string>")
    found = inverted.top_k(spark, str(tmp_path / "index"), asked, 3, buckets=4).rows
    assert sorted((r.zim_id, r["rank"], r.path) for r in found.collect()) == [(0, 0, "p102"), (0, 1, "p12"), (0, 2, "p120"), (1, 0, "p111"), (1, 1, "p129"), (1, 2, "p147")]


def test_shortlist_of_an_archive_is_made_once(spark, tmp_path):
    n = 1500
    rows = [[((i * 7 + k * 3) % 11 - 5) / 7 for k in range(4)] for i in range(n)]
    written(tmp_path, "embeddings", vec_id=list(range(n)), label=pa.array([i % 2 if i % 97 else None for i in range(n)], pa.int32()), embedding=pa.array(rows, pa.list_(pa.float32())))
    assert check(spark, registry.queries()["static_shortlist"], registry.oracle_sql()["static_shortlist"], tmp_path) > 500
    plan = registry.queries()["static_shortlist"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and len(re.findall(r" Window .*windowspecdefinition\(query_id", plan)) == 1, plan  # of the best alone


def test_copies_are_told_from_sets_without_moving_them(spark):
    one, two = [f"a{i} b" for i in range(20)], [f"c{i} d" for i in range(20)]
    rows = spark.createDataFrame([(0, "s", two), (1, "s", one), (1, "s", two), (2, "s", one[:19] + ["e f"]), (3, "s", one)], "doc_id long, source string, bg array<string>")
    near, member = pipeline.likely_sets(rows, 0.85)
    assert sorted((r.ha, r.hb, round(r.likeness, 3)) for r in near.collect()) == [(1, 2, 0.905)]  # a copy under another set's id is no set of its own
    assert sorted(map(tuple, member.collect())) == [(0, 0), (0, 1), (1, 1), (1, 3), (2, 2)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "Exchange hashpartitioning(set_key" not in plan


def test_texts_of_candidates_stay_where_they_are(spark, tmp_path):
    searched(tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("score_lexical_overlap", "snippet_window", "evidence_tiers", "uncovered_spans", "gold_in_top_n"):
            lines = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
            dealt = [b for a, b in zip(lines[:-1], lines[1:], strict=True) if "hashpartitioning" in a and "Aggregate(" not in b]
            assert any("text#" in line for line in lines) and not any("text#" in line and "item_id" not in line for line in dealt), (name, dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("score_lexical_overlap", "evidence_tiers", "uncovered_spans", "gold_in_top_n", "ranking_metrics_by_slice"):
        assert check(spark, registry.queries()[name], registry.oracle_sql()[name], tmp_path) > 0

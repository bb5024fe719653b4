from __future__ import annotations

import random

import pytest

from quillon.operators import search
from quillon.plans import pipeline

WORDS = ["river", "bank", "tower", "the", "of", "iron", "bridge", "world", "fair", "été"]


@pytest.fixture(scope="module")
def library(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 2, 3]), f"d{i}", " ".join(draw.choices(WORDS, k=3)).title(), " ".join(draw.choices(WORDS, k=60)) + ".", "en", 300, i) for i in range(80)]
    return spark.createDataFrame(rows, "zim_id int, path string, title string, text string, lang string, n_chars int, doc_id long")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "iron bridge"), (2, "What is the tower of été?"), (3, "nowhere to be found river")], "item_id long, raw string")


def test_profiles_share_the_stages_they_begin_with(spark, library, asked):
    base = pipeline.PROFILES["lexical"]
    runs = [*pipeline.sweep(base, "topk_budget.budget=40,120"), *pipeline.sweep(base, "rrf.k=5,20")]
    stages = pipeline.Stages()
    shared = [sorted(map(str, pipeline.run(spark, library, asked, p, stages=stages).selected.collect())) for p in runs]
    alone = [sorted(map(str, pipeline.run(spark, library, asked, p).selected.collect())) for p in runs]
    assert shared == alone and len({tuple(x) for x in shared}) > 1
    # Two budgets, and one more fuser (k = 20 is the profile's own) with all that follows it; the search is run once.
    assert sorted(stages.runs) == sorted(["queries", "normalize", "fulltext", "rrf", "candidate_articles", "lexical_overlap", "topk_budget", "topk_budget", "rrf", "candidate_articles", "lexical_overlap", "topk_budget", "topk_budget"])


def test_a_stage_is_not_planned_again_by_those_after_it(spark, library, asked):
    cards = pipeline.run(spark, library, asked, pipeline.PROFILES["hybrid"]).cards
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "MapInArrow" not in plan and plan.count("Exchange") <= 8


def test_untitled_articles_are_named_by_their_path(spark, asked):
    rows = [(1, "p/one", "", "An iron bridge. " * 5, "en", 80, 1), (1, "p/two", "Iron Bridge", "An iron bridge. " * 5 + "Of iron.", "en", 80, 2)]
    untitled = spark.createDataFrame(rows, "zim_id int, path string, title string, text string, lang string, n_chars int, doc_id long")
    assert {(r.path, r.title) for r in pipeline.run(spark, untitled, asked, pipeline.PROFILES["lexical"]).cards.where("item_id = 1").collect()} == {("p/one", "p/one"), ("p/two", "Iron Bridge")}


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_titles_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "RANGE", 7)
    draw = random.Random(9)
    titles = [("".join(draw.choices("aAbBé中\U0001f600", k=draw.randrange(6))), draw.choice([1, 2]), f"p{i:03}") for i in range(150)] + [("same", 1, f"q{i:03}") for i in range(60)]
    rows = spark.createDataFrame([(z, p, t) for t, z, p in titles] + [(1, "none", None)], "zim_id int, path string, title string")
    asked = [(i, "".join(draw.choices("aAbé中\U0001f600", k=draw.randrange(4)))) for i in range(40)] + [(90, "same"), (91, " SAM "), (92, "zzz"), (93, None)]
    found = search.titles_with_prefix(spark.createDataFrame(asked, "item_id long, prefix string"), rows, limit).collect()
    expected = set()
    for item, prefix in asked:
        prefix = (prefix or "").strip().lower()
        for zim in (1, 2):
            own = sorted((t.lower(), p) for t, z, p in titles if z == zim and prefix and t.lower().startswith(prefix))
            expected |= {(item, zim, p, k) for k, (_, p) in enumerate(own[:limit])}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)

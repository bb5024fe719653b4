from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import search


def articles(spark):
    rows = [(1, "a", "Paris town", "Paris is the capital of France"), (1, "b", "Paris", "the tower of paris paris"), (2, "c", "London", "London is a town"), (2, "d", "Lo", "no")]
    return spark.createDataFrame(rows, "zim_id int, path string, title string, text string")


def test_postings_count_terms(spark):
    found = {(r.path, r.term): (r.tf, r.dl) for r in search.postings(articles(spark)).collect()}
    assert found["b", "paris"] == (2, 5) and found["a", "paris"] == (1, 6) and len(found) == 6 + 4 + 4 + 1
    part = search.asked_postings(articles(spark), spark.createDataFrame([("paris",), ("paris",)], "term string"))
    assert {(r.path, r.tf, r.dl) for r in part.collect()} == {("a", 1, 6), ("b", 2, 5)}


def test_all_terms_or_any(spark):
    asked = spark.createDataFrame([(7, ["paris", "tower"])], "item_id long, terms array<string>")
    assert {r.path for r in search.matches(asked, articles(spark)).collect()} == {"b"}
    assert {r.path for r in search.matches(asked, articles(spark), every=False).collect()} == {"a", "b"}


def test_scores_of_a_task_do_not_grow_with_the_archive(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 100, raising=False)
    asked = spark.createDataFrame([(i, ["common", f"w{i}"]) for i in range(10)], "item_id long, terms array<string>")
    for n in (100, 400):
        docs = spark.range(n).select(F.lit(1).alias("zim_id"), F.concat(F.lit("d"), "id").alias("path"), F.lit("common words").alias("text"))
        in_tasks = [r["count"] for r in search.matches(asked, docs, every=False).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(in_tasks) == 10 * n and max(in_tasks) <= 300


def test_spans_prefer_exact_titles(spark):
    spans = spark.createDataFrame([(7, ["Paris", "Lon"])], "item_id long, spans array<string>")
    assert {(r.path, r["rank"]) for r in search.titles_of_spans(spans, articles(spark)).collect()} == {("b", 4), ("c", 4)}


def test_uncovered_and_shortened(spark):
    spans = spark.createDataFrame([(7, ["The  Tower", "Berlin"])], "item_id long, spans array<string>")
    held = articles(spark).select(F.lit(7).cast("long").alias("item_id"), "zim_id", "path")
    assert [(r.span_no, r.span) for r in search.uncovered(spans, held, articles(spark)).collect()] == [(1, "Berlin")]
    asked = spark.createDataFrame([(1, ["paris", "capital", "qq", "rr"]), (2, ["london"]), (3, ["zz"])], "item_id long, terms array<string>")
    assert {r.item_id: (r.variant, round(r.top, 3)) for r in search.shortened(asked, articles(spark), 0.9).collect()} == {1: (2, 1.0), 2: (0, 1.0), 3: (0, 0.0)}


def test_ladder(spark):
    def rungs(text):
        return [r["name"] for r in spark.range(1).select(search.ladder(F.lit(text)).alias("r")).first().r]

    assert rungs("mount a usb drive") == ["all_terms", "or_of_terms", "title"] and rungs("how is usb") == ["all_terms", "stopword_stripped", "or_of_terms", "title"] and rungs("the") == ["title"]


def test_short_prefixes_have_titles(spark):
    known = spark.createDataFrame([(1, "a", "UK economy"), (1, "b", "ukulele"), (1, "c", "東京"), (1, "d", "Uganda"), (1, "e", "AI")], "zim_id int, path string, title string")
    asked = spark.createDataFrame([(1, "UK"), (2, "東京"), (3, "u"), (4, "uku"), (5, " ")], "item_id long, prefix string")
    found = search.titles_with_prefix(asked, known, 5)
    assert sorted((r.item_id, r.path, r["rank"]) for r in found.collect()) == [(1, "a", 0), (1, "b", 1), (2, "c", 0), (3, "a", 1), (3, "b", 2), (3, "d", 0), (4, "b", 0)]

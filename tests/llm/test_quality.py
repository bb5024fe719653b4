from __future__ import annotations

import math
import random
import zlib

from pyspark.sql import functions as F

from quillon.llm import quality

SCHEMA = "doc_id long, text string"


def corpus(n=600):
    draw = random.Random(10)
    docs, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(draw.randrange(40)) * (draw.random() < 0.3) for _ in range(draw.randrange(5, 80))]
        text = " ".join(words) + "." if good else draw.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + "$$$" for w in words), (words[0] + " ") * 40])
        docs.append((i, text))
        labels.append((i, int(good if draw.random() > 0.03 else not good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = quality.scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: q for d, q, _ in labels}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(300)
    table = spark.createDataFrame(docs, SCHEMA)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = (quality.scores(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(1)).orderBy("doc_id").collect() for x in (labels, turned))
    assert [round(r.score, 9) for r in a] == [round(r.score, 9) for r in b]


def test_odd_tables(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "word " * 20_000, "z"), (2, "", "y")], SCHEMA + ", log_chars string")
    none = quality.scores(docs, spark.createDataFrame([], labels)).collect()
    assert len(none) == 4 and {r.score for r in none} == {0.5}
    one = quality.keep_good(docs, spark.createDataFrame([(i, 1, 0) for i in range(50)], labels))
    assert one.columns == docs.columns and one.count() == 4
    assert quality.scores(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], labels)).count() == 0


def test_rules_are_read_from_trees():
    tree = "DecisionTreeModel\n  If (feature 1 <= 0.5)\n   If (feature 2 <= 3.0)\n    Predict: 1\n   Else (feature 2 > 3.0)\n    Predict: 0\n  Else (feature 1 > 0.5)\n   Predict: 0\n"
    a, b, c, d = ((1, "<=", 0.5),), ((1, "<=", 0.5), (2, "<=", 3.0)), ((1, "<=", 0.5), (2, ">", 3.0)), ((1, ">", 0.5),)
    assert quality.rules_of(tree) == {a, b, c, d}


def test_statistics(spark):
    row = spark.createDataFrame([("AB cd cd\ncd | ##!",)], "text string").select(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).first()
    assert row.distinct_words == 4 / 6 and row.shouted == 1 / 6 and row.bars == 1 / 6 and row.symbols == 1 / 6 and row.bangs == 1 / 6 and row.line_words == 3


def test_compiled_score_is_that_of_the_rules(spark, monkeypatch):
    docs, labels = corpus(300)
    rules = []
    monkeypatch.setattr(quality, "compiled", lambda rule, own=quality.compiled: rules.append((rule, own(rule))) or rules[-1][1])
    table, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(table, marks)
    assert len(model) > 2
    kept = [(next(r for r, c in rules if c is column), weight) for column, weight in model[1:]]
    stats = quality.with_statistics(table).select("doc_id", *quality.NAMES, quality.score_of(model).alias("score")).collect()
    for r in stats:
        total = model[0][1] + sum(w for rule, w in kept if all((r[quality.NAMES[f]] <= b) == (sign == "<=") for f, sign, b in rule))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_stage_keeps_odd_columns(spark):
    docs, labels = corpus(120)
    odd = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", label string, `a``b` int")
    kept = quality.keep_good(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count() and {r["a`b"] for r in kept.collect()} == {1}
    assert quality.keep_good(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0

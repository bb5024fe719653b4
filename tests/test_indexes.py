from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import cells, greedy, inverted, patterns, search, vectors

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    weights = [30 / (i + 1) for i in range(30)]
    rows = [(draw.choice([1, 1, 1, 2]), f"p{i:04}", " ".join(draw.choices(words, weights, k=draw.randrange(1, 80)))) for i in range(600)] + [(3, "empty", "")]
    return spark.createDataFrame(rows, "zim_id int, path string, text string")


def test_stored_index_ranks_like_a_full_search_and_skips_blocks(spark, library, tmp_path):
    inverted.write_index(library, str(tmp_path / "index"), buckets=16, block=16)
    asked = spark.createDataFrame([(1, ["w0"]), (2, ["w1", "w7"]), (3, ["w28", "w29", "w3"]), (4, ["nowhere", "w0"]), (5, ["w20", "w0", "w1"])], "item_id long, terms array<string>")
    found = inverted.top_k(spark, str(tmp_path / "index"), asked, 5, buckets=16)
    full = search.ranked(search.matches(asked, library), 5, "item_id", "zim_id")

    def shown(rows):
        return sorted((r.item_id, r.zim_id, r["rank"], r.path, round(r.score, 9)) for r in rows.collect())

    assert shown(found.rows) == shown(full) and len(shown(full)) > 20
    asked_blocks, read = found.asked.count(), found.read.agg(F.sum("n_terms")).first()[0]
    assert 0 < read < 0.8 * asked_blocks, (read, asked_blocks)
    plan = found.rows._jdf.queryExecution().toString()
    assert "bucket" not in plan or "PartitionFilters" in plan


def test_patterns_against_contains(spark):
    draw = random.Random(4)
    texts = [(i, 7, "".join(draw.choices("ab é中", k=draw.randrange(60)))) for i in range(80)] + [(100, 7, None), (101, 7, "")]
    wanted = sorted({"".join(draw.choices("abé中 ", k=draw.randrange(1, 5))) for _ in range(60)})
    frame = spark.createDataFrame(texts, "doc long, n int, text string")
    asked = spark.createDataFrame([(w,) for w in wanted] + [("",), (None,), (wanted[0],)], "pattern string")
    expected = sorted((i, n, w) for i, n, t in texts for w in wanted if t and w in t)
    for most in (5_000_000, 20):  # one automaton, and several
        assert sorted(map(tuple, patterns.held(frame, asked, most).collect())) == expected
    assert patterns.held(frame, asked.limit(0)).columns == ["doc", "n", "pattern"]


def test_cells_find_what_an_exact_search_finds(spark, tmp_path):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((25, 16))
    x = np.repeat(centres, 40, axis=0) + 0.35 * draw.standard_normal((1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 3, i // 4, v.tolist()) for i, v in enumerate(x)], "vec_id long, zim_id int, article_id long, embedding array<double>")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "zim_id", "embedding")
    index = cells.build(rows, str(tmp_path / "cells"))
    assert sum(index.sizes.values()) == 1000  # every vector is in a cell
    probes = cells.probes_for(spark, index, rows, asked, 10)
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(rows, asked, 10).collect()}
    found = cells.nearest(spark, index, asked.select("query_id", "embedding"), 10, probes).collect()
    assert len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(exact)
    assert cells.read_share(index, asked, probes) < 0.35
    by_hand = {(q, v): float(x[q] @ x[v]) for q, v in ((r.query_id, r.vec_id) for r in found)}
    assert all(abs(r.score - by_hand[r.query_id, r.vec_id]) < 1e-9 for r in found)


def test_recall_over_the_given_vectors(spark):
    from quillon.plans import registry

    rows = registry.queries()["cells_knn_recall"](spark, DATA).collect()
    assert sum(r.exact for r in rows) >= 0.9 * len(rows)


@pytest.mark.parametrize("density", [0.01, 0.1, 0.6])
def test_greedy_rule_in_parallel(spark, density):
    draw = random.Random(density)
    pairs = [(i, j) for j in range(60) for i in range(j) if draw.random() < density] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (9, 3)]
    taken, near = set(), {frozenset(p) for p in pairs if p[0] != p[1]}
    for n in sorted({x for p in pairs for x in p}):
        if not any(frozenset((n, m)) in near for m in taken):
            taken.add(n)
    gone = {r.node for r in greedy.dropped(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert gone == {x for p in pairs for x in p} - taken


def test_first_words(spark):
    texts = ["", "  ", "one", " one  two\n three ", "a b c d e f", "\t x\u00a0y z"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", T.first_words(F.col("t"), 4).alias("w")).collect()
    import re

    assert [r.w for r in rows] == [None if r.t is None else " ".join([w for w in re.split(r"[ \t\n\x0b\f\r]+", r.t) if w][:4]) for r in rows]

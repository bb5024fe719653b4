from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, rounds, scale=64):
    """All of it in Python's integers."""
    x = [(i, [math.floor(Fraction(v) * scale) for v in e]) for i, e in rows]
    name = {i: hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, _ in x}
    centroids = [v for _, v in sorted(x, key=lambda r: (name[r[0]], r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own: dict[int, list] = {}
        for _, v in x:
            own.setdefault(nearest(v)[1], []).append(v)
        for j, members in own.items():
            centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [(i, *nearest(v)) for i, v in x]
    per = {j: sum(d for _, d, c in last if c == j) for j in range(k)}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fits(v):
        return v if v < 2**63 else None

    return sorted((i, j, fits(d), fits(per[j]), fits(sum(per.values())), shown[j]) for i, d, j in last)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA.replace("label int", "cluster int, `a.b` string"))
    return sorted(tuple(r) for r in clustering.clustered(frame, **how).collect())


@pytest.mark.parametrize("size", [1, 3e4, 1e6, 1e9, 1e18, 1e200])
def test_clusters_are_those_of_exact_integers(spark, size):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.standard_normal(8) * (size if i % 3 else 1)).tolist()) for i in range(200)]
    assert found(spark, rows, k=7, rounds=3, dim=8) == brute(rows, 7, 3)


def test_each_path_gives_the_same_distances():
    draw = np.random.default_rng(1)
    x = np.floor(draw.standard_normal((50, 64)) * 100)
    centroids = [[int(v) for v in row] for row in np.floor(draw.standard_normal((5, 64)) * 100)]
    exact = [[sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids] for row in x]
    assert clustering.distances(x, centroids).tolist() == exact
    assert clustering.distances(clustering.exact(x), centroids).tolist() == exact
    for far in (1e9, 1e30):  # one row beyond the bound leaves the others as they are
        wide = np.vstack([x, np.full((1, 64), far)])
        assert clustering.distances(wide, centroids).tolist()[:-1] == exact
        assert clustering.distances(wide, centroids).tolist()[-1] == [sum((int(far) - b) ** 2 for b in c) for c in centroids]


def test_odd_rows(spark):
    good = [(3, [0.5, -0.01]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (8, [-0.0, 0.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 3.0])]
    assert found(spark, good + bad, k=2, dim=2) == brute(good, 2, 3)
    assert found(spark, good + bad, k=50, dim=2) == brute(good, 50, 3)  # more centroids than vectors
    ids = [r[0] for r in clustering.clustered(spark.createDataFrame([(None, [1.0, 1.0], 1), (2, [5.0, 5.0], 1)], SCHEMA), k=1, dim=2).collect()]
    assert sorted(ids, key=str) == [2, None]
    assert found(spark, [], dim=2) == found(spark, bad, dim=2) == []

from __future__ import annotations

import numpy as np
import pytest

from quillon.llm import collisions

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(seed: int, rows: int, dim: int = 64):
    """Vectors of a few labels: families at cosines about 0.98 around a centre, copies, and others far apart."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        centre = draw.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(int(draw.integers(1, 6))):
            off = draw.standard_normal(dim)
            off -= centre * (off @ centre)
            off *= draw.choice([0.05, 0.1, 0.14, 0.2]) / np.linalg.norm(off)
            out.append(((centre + off) * draw.uniform(0.1, 9), i % 3))
        if i % 7 == 0:
            out += [out[-1]] * 3
    return [(k, x.astype(np.float32).tolist(), label) for k, (x, label) in enumerate(out)]


def brute(rows, cosine: float = 0.98):
    """n_links and component_id by comparing all pairs."""
    links, name = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    pairs = []
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pairs += [(own[i][0], own[j][0]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(name[a], name[b])
            changed |= name[a] != least or name[b] != least
            name[a] = name[b] = least
    return links, name


@pytest.mark.parametrize(("size", "long"), [(512, 4096), (16, 4096), (4096, 24)])
def test_all_links_of_planted_families(spark, size, long):
    rows = planted(5, 250)
    links, name = brute(rows)
    found = collisions.near_vectors(spark.createDataFrame(rows, SCHEMA), size=size, long=long).collect()
    assert sorted(r.vec_id for r in found) == sorted(links)
    assert all(r.n_links <= links[r.vec_id] for r in found)  # none below the threshold, none counted twice
    assert sum(r.n_links for r in found) >= 0.995 * sum(links.values()) > 500
    assert sum(r.component_id == name[r.vec_id] for r in found) >= 0.99 * len(found)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_a_dense_group_is_counted_whole(spark):
    draw = np.random.default_rng(2)
    centre = draw.standard_normal(64)
    rows = [(i, (centre + 0.02 * draw.standard_normal(64)).tolist(), 1) for i in range(300)] + [(300 + i, centre.tolist(), 1) for i in range(200)]
    found = collisions.near_vectors(spark.createDataFrame(rows, SCHEMA), long=64).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(499, 0)}


def test_odd_rows(spark):
    x, y = [1.0, 2.0, 2.0], [1.0, 2.0, 2.0001]
    rows = [
        (1, x, 1), (2, y, 1), (3, x, 2), (4, x, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 2.0], 1),
        (10, [1.0, float("inf"), 2.0], 1), (11, [*x, 0.0], 1), (12, [3e38, 3e38, 1.0], 3), (13, [1e-40, 1e-40, 0.0], 3), (2, y, 1), (None, x, 1), (None, x, 9), (None, x, 9), (None, None, 1),
    ]
    odd = spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA + ", node string, `a.b` int")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in collisions.near_vectors(odd).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (12, 1, 12, True), (13, 1, 12, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert found == sorted(alone + linked, key=str)


def test_empty(spark):
    assert collisions.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scheme_holds_its_odds():
    draw = np.random.default_rng(4)
    for rows in (10, 5_000, 2_000_000):
        plan = collisions.scheme(rows)
        x = draw.standard_normal((4000, 64))
        off = draw.standard_normal(x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        off -= x * (off * x).sum(1, keepdims=True)
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
        sort_by, planes = collisions.directions(64, plan)
        near = np.abs(x @ sort_by - y @ sort_by) <= plan.window
        if plan.bits:
            near &= ((x @ planes > 0) == (y @ planes > 0)).reshape(len(x), plan.tables, plan.bits).all(2)
        assert (near.sum(1) >= plan.least).mean() >= 0.998

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing
from quillon.llm._common import permuted

SCHEMA = "doc_id long, text string, source string"


def table(spark, extra=()):
    draw = random.Random(9)
    rows = [(i, draw.choice(" \n") + " ".join(f"t{i}_{k}" for k in range(draw.randrange(1200))), draw.choice(["big"] * 5 + ["b", "é", "", None])) for i in range(120)]
    return rows + list(extra)


def brute_targets(rows, share=1.5, most=2):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not full:
            return sizes, target | {s: unit * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return sizes, target


def test_targets_and_takes(spark):
    rows = table(spark, [(500, None, "b"), (501, "", "zzz"), (502, "w " * 500, "one"), (502, "w " * 500, "one"), (None, "x y z", None)])
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], SCHEMA + ", size int, key string")
    found = mixing.taken(docs).collect()
    sizes, target = brute_targets(rows)
    own = [(d, s) for d, _, s in rows]
    assert len(found) == len(rows)
    source = {d: s for d, s in own}
    took = Counter()
    for r in found:
        assert r.taken <= 2 * r.size and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        took[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(took[s] - target[s]) <= mixing.BLOCK + 0.01 * sizes[s], s
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_rows_hold_what_is_taken(spark):
    rows = table(spark)
    docs = spark.createDataFrame([(*r, len(r[1]), "k") for r in rows], SCHEMA + ", n_chars long, row string")
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    texts = {d: t for d, t, _ in rows}
    got = Counter()
    for r in mix.collect():
        assert r.n_chars == len(r.text) and r.row == "k"
        words = r.text.split()
        assert set(words) <= set(texts[r.doc_id].split()) and words == sorted(words, key=lambda w: int(w.split("_")[1]))
        got[r.doc_id] += len(words)
    assert got == Counter({r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken})


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_permutation(spark, n):
    out = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3)).alias("p")).collect()]
    assert sorted(out) == list(range(n)) and (n < 1000 or out != sorted(out))


def test_empty(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], SCHEMA)
    assert [r.taken for r in mixing.taken(none).collect()] == [0, 0]


def drawn(spark, monkeypatch, slack, shard_blocks=50):
    monkeypatch.setattr(mixing, "SLACK", slack)
    sources = mixing.targets(mixing._sized(spark.createDataFrame(table(spark), SCHEMA)))
    rows = mixing.drawn_blocks(sources, shard_blocks=shard_blocks).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(r.slot < shard_blocks for r in rows)
    own = {r.key: r for r in sources.collect() if r.draws}
    for key, source in own.items():
        numbers, times = sorted(r.draw for r in rows if r.key == key), Counter(r.block for r in rows if r.key == key)
        assert numbers == list(range(len(numbers))) and max(times) < source.blocks
        assert not times or (max(times.values()) - (min(times.values()) if len(times) == source.blocks else 0) <= 1 and max(times.values()) <= 2)
    return rows, own


def test_sources_far_off_are_held_to_their_draws(spark, monkeypatch):
    rows, own = drawn(spark, monkeypatch, 0)
    assert Counter(r.key for r in rows) == {k: r.draws for k, r in own.items()}
    total = sum(r.draws for r in own.values())
    assert sorted((r.shard, r.slot) for r in rows) == [(i // 50, i % 50) for i in range(total)]  # no slot stays empty


def test_counts_of_shards_are_multinomial(spark, monkeypatch):
    rows, own = drawn(spark, monkeypatch, 9)
    total = sum(r.draws for r in own.values())
    for key, source in own.items():
        p, counts = source.draws / total, Counter(r.shard for r in rows if r.key == key)
        n, sd = sum(counts.values()), (total * p * (1 - p)) ** 0.5
        assert abs(n - source.draws) <= 5 * sd or n == 2 * source.blocks
        whole = [counts[s] for s in range(total // 50)]
        assert all(abs(c - 50 * p) <= 6 * (50 * p * (1 - p)) ** 0.5 + 1 for c in whole)
        if p > 0.2:  # the spread of counts is that of independent draws
            assert 0.4 <= sum((c - 50 * p) ** 2 for c in whole) / len(whole) / (50 * p * (1 - p)) <= 2
    assert any(sum(r.key == k for r in rows) != own[k].draws for k in own)  # counts follow the draws, not the targets


def test_shard_counts(spark):
    docs = spark.createDataFrame(table(spark), SCHEMA)
    counts = mixing.shard_counts(docs, shard_blocks=100).collect()
    assert len({r.shard for r in counts}) > 3 and max(sum(r.blocks for r in counts if r.shard == s) for s in {r.shard for r in counts}) <= 100


def test_rows_by_shard_hold_what_the_shards_take(spark):
    rows = table(spark)
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], SCHEMA + ", `a``b` map<string,int>")
    parts = mixing.mixed(docs, by_shard=True, shard_blocks=100)
    assert parts.columns == [*docs.columns, "mix_shard", "mix_slot"]
    parts, counts = parts.collect(), Counter()
    for r in parts:
        assert 0 <= r.mix_slot < 100
        counts[r.mix_shard] += len(r.text.split())
    whole = Counter()
    for r in mixing.mixed(docs).collect():
        whole[r.doc_id] += len(r.text.split())
    by_doc = Counter()
    for r in parts:
        by_doc[r.doc_id] += len(r.text.split())
    assert by_doc == whole and len(counts) > 1 and max(counts.values()) <= 100 * mixing.BLOCK

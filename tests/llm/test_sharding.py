from __future__ import annotations

import zlib
from collections import Counter

from quillon.llm import sharding

SCHEMA = "doc_id long, text string"


def test_law_rows(spark):
    rows = [(i, "é" * (i % 5)) for i in range(103)] + [(None, None), (7, "x"), (7, "x"), (500, None)]
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], SCHEMA + ", shard string, __number int")
    found = sharding.assign_shards(docs).collect()
    assert len(found) == len(rows)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    sizes = sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in found)
    assert sizes == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    again = sharding.assign_shards(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_columns_are_carried(spark):
    docs = spark.createDataFrame([(1, "a", "k", 4, 0), (2, "b", "m", 5, 0)], SCHEMA + ", slot string, lang int, `a``b` int")
    out = sharding.assign_shards(docs, shards=2, keep=True)
    assert out.columns == ["doc_id", "text", "lang", "a`b", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.doc_id, r.text, r.lang) for r in out.collect()) == [(1, "a", 4), (2, "b", 5)]


def test_shuffled_and_empty(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(400)], SCHEMA)
    order = [r.doc_id for r in sharding.assign_shards(docs, shards=1).orderBy("slot").collect()]
    assert order != sorted(order) and sorted(order) == list(range(400))
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0

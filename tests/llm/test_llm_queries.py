from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = queries.queries()[name](spark, str(DATA))
    assert sorted(rows.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in found.fetchall()) == sorted(str(tuple(r[c] for c in names)) for r in rows.collect())


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(DATA)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids, kept = {r.doc_id for r in before.select("doc_id").collect()}, [r.doc_id for r in after.select("doc_id").collect()]
        assert set(kept) <= ids
        if name != "shard":
            assert after.columns == columns
        if name == "near_dedup":
            from quillon.llm import simhash

            assert sorted(kept) == sorted({r.component_id for r in simhash.near_copies(before).collect()})
            assert set(kept) <= {r.component_id for r in simhash.near_duplicates(before).collect()}
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            like = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in ids for y in ids if x < y}
            assert not [p for p in like if like[p] >= 0.8 and {*p} <= set(kept)]  # no near copy of a document that stays is left
            assert all(any(like[min(x, y), max(x, y)] >= 0.6 for y in ids - {x}) for x in ids - set(kept))  # nothing else goes
        if name == "decontaminate":
            from quillon.llm import decontaminate

            hit = decontaminate.scan(before, spark.read.parquet(str(DATA / "benchmark.parquet"))).where("size(hits) > 0")
            assert sorted(kept) == sorted(ids - {r.doc_id for r in hit.collect()})
        if name == "shard":
            assert after.count() == before.count() and {"shard", "slot"} <= set(after.columns)
        before = after
    assert corpus_pipeline.run(spark, str(DATA)).count() == before.count()

"""Every registered query with SQL gives the rows that DuckDB gives for that SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quillon.plans import registry
from tests.inline_cases import CASES

DATA, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
SQL = registry.oracle_sql()
#: What writes files, pages or state is run on more than a page of rows as well.
AGAIN = sorted(n for n, r in registry.REGISTRY.items() if r.sql and r.run.__module__.rsplit(".", 1)[-1] in ("storage", "streams"))


def plain(x):
    if x is None:
        return None
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def connected(data):
    connection = duckdb.connect()
    for path in data.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def check(spark, run, sql, data):
    frame, found = run(spark, str(data)), connected(data).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    theirs = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert all(same(a, b) for a, b in zip(ours, theirs, strict=True))
    return len(ours)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(spark, registry.queries()[name], SQL[name], DATA)


@pytest.mark.skipif(not LARGER.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", AGAIN)
def test_query_matches_sql_on_more_rows(spark, name):
    check(spark, registry.queries()[name], SQL[name], LARGER)


@pytest.mark.parametrize("name", sorted(CASES))
def test_inline_case(spark, name):
    check(spark, *CASES[name], DATA)


def same(a, b):
    return all((isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and math.isclose(x, y, abs_tol=1e-5)) or str(x) == str(y) for x, y in zip(a, b, strict=True))


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_entry_has_rows(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0

"""All registered queries of the library, with SQL equivalents.

A query is registered with the ids of the operators it shows and, where SQL can express it, SQL for the same rows.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    operators: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Registered] = {}
MODULES = ["search", "ranking", "evaluation", "runs", "traces", "catalogue", "vectors", "ingest", "assembly", "storage", "streams", "content"]


def query(*operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(function: Query) -> Query:
        REGISTRY[function.__name__] = Registered(function, operators, sql)
        return function

    return add


def _loaded() -> dict[str, Registered]:
    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")
    return REGISTRY


def queries() -> dict[str, Query]:
    return {name: r.run for name, r in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: r.sql for name, r in _loaded().items() if r.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded()["retrieve_hybrid"].run(spark, sf_dir)

"""All registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PLANS = ("solar", "ingest", "campus", "graph", "shade", "routes", "observations", "documents")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with SQL for the same rows if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"penumbra.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

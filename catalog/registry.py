"""The registered queries and their oracle SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from catalog.fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB equivalent."""
    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register

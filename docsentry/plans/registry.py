"""Registry of runnable queries and their SQL cross-checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, the inventory rows it covers and, where SQL can express it, its cross-check."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql:
            ORACLES[name] = sql
        return fn

    return add

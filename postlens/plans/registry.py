"""Registry of named queries over the test tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ids`` names the SURVEY inventory rows it covers; ``sql`` is the
    equivalent DuckDB query (None when the operator is not SQL-expressible).
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco

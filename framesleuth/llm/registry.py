"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same rows in DuckDB."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")

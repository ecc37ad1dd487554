"""Registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonewright.queries.tables import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` with its DuckDB text, if any.

    ``tables`` names the derived tables the SQL uses.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = with_ctes(sql, *tables) if tables else sql.strip()
        return fn

    return register

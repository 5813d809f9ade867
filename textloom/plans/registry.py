"""The catalogue of queries: each has a Spark plan and, where SQL can express it, DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries over small literal tables: for records that the given tables have nothing like.  They are tested, and not part of the catalogue.
FIXTURES: dict[str, Query] = {}
FIXTURE_SQL: dict[str, str] = {}


def fixture(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FIXTURES[f.__name__], FIXTURE_SQL[f.__name__] = f, sql
        return f

    return add


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add

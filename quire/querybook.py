"""Books of queries: each module registers its queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def book() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL by name, the decorator that adds a query and its SQL, if it has any)."""
    queries: dict[str, Query] = {}
    sql_of: dict[str, str] = {}

    def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            queries[name] = f
            if sql:
                sql_of[name] = sql
            return f

        return wrap

    return queries, sql_of, add

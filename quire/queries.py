"""Registry of the core's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import catalogue_queries, layout_queries, nested_queries, outline_queries, resolve_queries, structure_queries, text_queries
from quire.plans import plan_queries
from quire.sources import source_queries
from quire.streaming import stream_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (nested_queries, layout_queries, text_queries, resolve_queries, structure_queries, plan_queries, source_queries, stream_queries, catalogue_queries, outline_queries)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE

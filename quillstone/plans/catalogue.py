"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query."""
    return QUERIES["hybrid_search"](spark, folder)


from quillstone.plans import evaluation_queries, graph_queries, ingest_queries, scan_queries, search_queries, store_queries, sync_queries  # noqa: E402, F401

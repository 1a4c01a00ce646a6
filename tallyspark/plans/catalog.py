"""Registered queries over the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import budget_queries, detail_queries, flow_queries, graph_queries, overview_queries, page_queries, review_queries, source_queries, stat_queries, text_queries, window_queries  # noqa: F401

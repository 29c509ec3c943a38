"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from tidemark.plans import event_queries, graph_queries, join_queries, lifecycle_queries, lift_queries, metric_queries, path_queries, prompt_queries, rank_queries, retrieval_queries, scorecard_queries, search_queries, session_queries, text_queries  # noqa: E402, F401
from tidemark.plans import ledger_queries  # noqa: E402, F401  # after those whose SQL it uses

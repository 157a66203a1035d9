"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each entry maps a name to ``(spark, sf_dir) -> DataFrame`` and, where the
result is expressible in SQL, an oracle statement over the same tables.
Computed doubles are rounded on both sides so the value hashes compare
engines, not last-bit floating point noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query builder (and its oracle SQL) to the catalog."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from assaykit.plans import (queries_core, queries_graph, queries_io,  # noqa: F401
                                queries_models, queries_reports, queries_text)

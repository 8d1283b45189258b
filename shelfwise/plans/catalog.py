"""Query catalogue: one entry per operator ID of SURVEY §2.

Each entry pairs a Spark query over the driver tables with an equivalent DuckDB
SQL text (or None where SQL cannot express the operator; those are tested
against a brute-force twin on a small fixture instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.views import Tables, oracle

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (run, oracle(sql) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    """Import every catalogue module (each registers its queries)."""
    from shelfwise.plans import (  # noqa: F401
        q_stats, q_filters, q_joins, q_windows, q_compare, q_scalars, q_upsert, q_pages, q_io,
        q_streaming,
    )
    return REGISTRY

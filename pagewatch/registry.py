"""Registered queries (Spark side) and their DuckDB oracle SQL.

Every query reads the driver's tables (or tables Spark derives from them) in
full; nothing is capped or sampled except where sampling is the feature.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)  # also ships the package to Python workers
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    import importlib
    for mod in ("queries_detect", "queries_discover", "queries_io", "queries_text", "queries_topics",
                "queries_streams"):
        importlib.import_module(f"{__package__}.plans.{mod}")

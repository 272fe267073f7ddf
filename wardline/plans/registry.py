"""The registered queries by name, and the SQL that checks them. The modules that register them are imported when they are asked for."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from wardline.plans.frames import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("queries", "attribute_queries", "build_queries", "model_queries")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), its result rounded for comparison, and the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)

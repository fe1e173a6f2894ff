"""Where the query modules enter their queries and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqlviews import with_views
from .views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return enter


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


def bound(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))

"""Registry of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayloom.functions.measures import with_rounded
from dayloom.plans.standins import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round floating results so that two engines can be compared by value."""
    return with_rounded(df, names, digits)


def rsql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"ROUND({n}, {digits}) + 0.0 AS {n}" for n in names)

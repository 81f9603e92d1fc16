"""Registration of named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL where it can express the query."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def r6(value: Column | str) -> Column:
    """Rounded to six places, for comparison between engines; without negative zeros."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def named(metrics: dict[str, Column], whole: tuple[str, ...] = ()) -> list[Column]:
    return [long(m).alias(n) if n in whole else m.alias(n) for n, m in metrics.items()]

"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairscope.plans import more_plans, relational_plans, statistical_plans, text_plans  # noqa: F401
from pairscope.plans.base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from conversations -> text metrics, as F4."""
    return QUERIES["F4_lexical_metrics"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

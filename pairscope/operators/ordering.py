"""Row numbers and running sums within groups of any size, without bringing a group to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairscope.sources import io


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``row_idx``, each row's place (from 0) in its group's order.

    Rows are dealt in ranges of (group, order), numbered within their range, and shifted by what the group has in the
    ranges before: a table of one row per group and range. The dealt rows are written once, as ranges are sampled anew
    whenever a plan is run."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    path = io.scratch(spark, "numbered")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumns({"__part": F.shiftrightunsigned("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return _shifted(rows, parts, by, {"__n": "__shift"}).select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__shift")).alias("row_idx"))


def running_sums(df: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """df with NAME_before for each of values: its sum over the rows before, within the group's order.

    As with :func:`numbered`, a window sums within a range alone and a small table brings what comes before it."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    path = io.scratch(spark, "running")
    dealt.write.parquet(path)
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(dealt.schema).parquet(path)
    rows = rows.withColumns({f"__{v}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    parts = rows.groupBy(*by, "__part").agg(*[F.sum(v).alias(f"__{v}_all") for v in values])
    shifted = _shifted(rows, parts, by, {f"__{v}_all": f"__{v}_out" for v in values})
    return shifted.select(*df.columns, *[(F.col(f"__{v}_in") + F.col(f"__{v}_out")).alias(f"{v}_before") for v in values])


def _shifted(rows: DataFrame, parts: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """rows joined with parts (a row per group and range), whose columns sums are added up over the group's ranges before."""
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__{c}_of" for c in (*by, "__part")}
    others = [c for c in parts.columns if c not in names]
    shifts = parts.select(*[F.col(c).alias(n) for c, n in names.items()], *others, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in sums.items()])
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return rows.join(shifts, same)

"""Data contracts: each gives the rows that violate it; ``assert_empty`` turns any into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract doesn't hold; the message lists the first violations."""


def assert_empty(violations: DataFrame, message: str, shown: int = 10) -> None:
    found = violations.limit(shown).collect()
    if found:
        raise ContractError(f"{message}: {[r.asDict(recursive=True) for r in found]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def key_set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, with the side."""
    one = left.select(*keys).distinct().withColumn("in_left", F.lit(1))
    two = right.select(*keys).distinct().withColumn("in_right", F.lit(1))
    return one.join(two, keys, "full").where("in_left IS NULL OR in_right IS NULL").select(*keys, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("side"))


def incomplete_sets(df: DataFrame, key: str, member: str, required: list[str]) -> DataFrame:
    """Keys that lack required members, with the missing ones."""
    got = df.groupBy(key).agg(F.collect_set(F.when(F.col(member).isin(required), F.col(member))).alias("got"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("got"))
    return got.where(F.size(missing) > 0).select(key, F.array_join(F.array_sort(missing), ",").alias("missing"))


def unequal_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose rows don't all have one value; NULL counts as a value."""
    agg = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("held"), F.count(F.lit(1)).alias("n_rows"))
    return agg.where("low <> high OR (held > 0 AND held < n_rows)").select(key)


def not_paired(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Keys without exactly one row of a kind and one of none (NULL)."""
    agg = df.groupBy(key).agg(F.count_if(F.col(kind).isNull()).alias("n_clean"), F.count(kind).alias("n_conflict"))
    return agg.where("n_clean <> 1 OR n_conflict <> 1")


def not_in_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break rules, with the broken rules' names. A rule that is NULL counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", F.array_join(broken, ",")).where("broken <> ''")


def partial_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where some of the columns are filled and others blank."""
    filled = reduce(lambda a, b: a + b, [(F.trim(F.coalesce(c, F.lit(""))) != "").cast("int") for c in columns])
    return df.withColumn("filled", filled).where((F.col("filled") > 0) & (F.col("filled") < len(columns)))


def wrong_derivation(df: DataFrame, column: str, expected: Column) -> DataFrame:
    return df.withColumn("expected", expected).where(~F.col(column).eqNullSafe(F.col("expected")))


def not_functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def not_finite(df: DataFrame, features: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in features])
    return df.where(bad)


def small_classes(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < least)


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(test.select(group))


def wrong_counts(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Classes whose row count isn't the expected one, absent and unexpected ones included."""
    pins = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected long")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = counts.join(F.broadcast(pins), column, "full")  # as many pins as the caller wrote
    return joined.where(~F.col("n_rows").eqNullSafe(F.col("expected"))).select(column, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("expected", F.lit(0)).alias("expected"))


def overwritten(existing: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Confirmed values that incoming rows would change."""
    new = incoming.select(key, F.col(column).alias("incoming"))
    held = existing.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")
    return held.join(new, key).where(~F.col(column).eqNullSafe(F.col("incoming"))).select(key, column, "incoming")


def audit_scope(audit: DataFrame, label: str, key: str, known: DataFrame, expected: DataFrame) -> DataFrame:
    """What is wrong with an audit of rows (label, key): keys in several groups, keys that known lacks, expected keys that it misses, and extra ones."""
    groups = audit.groupBy(key).agg(F.count_distinct(label).alias("n_groups"))
    several = groups.where("n_groups > 1").select(key, F.lit("several groups").alias("problem"))
    unknown = groups.join(known.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    scope = key_set_difference(expected, groups, [key])
    return several.unionByName(unknown).unionByName(scope.select(key, F.when(F.col("side") == "left", "missing").otherwise("extra").alias("problem")))

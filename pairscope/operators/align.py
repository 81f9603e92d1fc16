"""Validated joins and pivots that pair conditions, actions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairscope.operators import contracts as C


def aligned(left: DataFrame, right: DataFrame, keys: list[str], validate: bool = True) -> DataFrame:
    """Inner 1:1 join; with validation, keys must be unique and equal on both sides."""
    if validate:
        for side in (left, right):
            C.assert_empty(C.duplicate_keys(side, keys), "duplicate keys")
        C.assert_empty(C.key_set_difference(left, right, keys), "records are not pair-aligned")
    return left.join(right, keys)


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Per key the row with the greatest ordinal."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return df.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def wide(df: DataFrame, key: str, member: str, members: list[str], values: list[str]) -> DataFrame:
    """One row per key with value_member columns. The members are named, so no scan looks for them."""
    cells = [F.max(F.when(F.col(member) == m, F.col(v))).alias(f"{v}_{m}") for v in values for m in members]
    return df.where(F.col(member).isin(members)).groupBy(key).agg(*cells)


def effect(before: Column, after: Column, epsilon: float = 0.0) -> Column:
    """helps, harms or tie by the change of a score; uncertain where a side is NULL."""
    return F.when(before.isNull() | after.isNull(), "uncertain").when(after - before > epsilon, "helps").when(before - after > epsilon, "harms").otherwise("tie")


def exploded_groups(audit: DataFrame, column: str) -> DataFrame:
    """A map of label -> ids as rows (label, id)."""
    return audit.select(F.explode(column).alias("label", "ids")).select("label", F.explode("ids").alias("id"))


def optional(left: DataFrame, right: DataFrame, key: str, column: str, fallback: Column) -> DataFrame:
    """Left join where a missing value is replaced."""
    return left.join(right.select(key, F.col(column).alias("__found")), key, "left").withColumn(column, F.coalesce("__found", fallback)).drop("__found")


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint if df has at most so many rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def upsert(base: DataFrame, changes: DataFrame, keys: str | list[str], columns: list[str]) -> DataFrame:
    """base with the values of changes where those aren't NULL. A value that base holds already and that differs is an error."""
    keys = [keys] if isinstance(keys, str) else keys
    renamed = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(renamed, keys, "left")
    conflict = None
    for c in columns:
        own = F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() & (F.col(c) != F.col(f"__{c}"))
        conflict = own if conflict is None else conflict | own
    C.assert_empty(joined.where(conflict).select(*keys), "confirmed labels disagree")
    merged = [F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*merged)


def audited(manifest: DataFrame, predictions: DataFrame, audit: DataFrame, key: str, candidate: str, accepted: list[str]) -> DataFrame:
    """Audited rows (label, key) of accepted labels with their manifest row and prediction. An id in two groups, a missing
    row on either side and an empty candidate are errors."""
    C.assert_empty(C.duplicate_keys(audit, [key]), "audited twice")
    asked = audit.where(F.col("label").isin(accepted))
    for name, side in (("manifest row", manifest), ("prediction", predictions)):
        C.assert_empty(C.duplicate_keys(side.join(asked.select(key), key, "left_semi"), [key]), f"more than one {name}")
        C.assert_empty(asked.join(side, key, "left_anti").select(key, "label"), f"audited without a {name}")
    joined = asked.join(manifest, key).join(predictions, key)
    C.assert_empty(joined.where(F.trim(candidate) == "").select(key), "empty candidates")
    return joined


def without_shared_groups(source: DataFrame, target: DataFrame, group: str) -> DataFrame:
    """Source rows whose group isn't in target."""
    return source.join(target.select(group).distinct(), group, "left_anti")

"""Deterministic quotas, stratified and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairscope.operators.contracts import ContractError
from pairscope.operators.ordering import numbered


def quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """Largest remainders: the shares' floors, and one more for the largest (fraction, group size, name) until size is met."""
    groups = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_rows"))
    total = Window.partitionBy(F.lit(1))
    raw = groups.withColumn("total", F.sum("n_rows").over(total)).withColumn("raw", F.lit(size) * F.col("n_rows") / F.col("total")).withColumn("floored", F.floor("raw"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("raw") - F.col("floored")), F.desc("n_rows"), F.desc(stratum))
    left = F.lit(size) - F.sum("floored").over(total)
    return raw.withColumn("place", F.row_number().over(order)).withColumn("left", left).select(stratum, "n_rows", (F.col("floored") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def shuffled_key(seed: int, key: Column) -> Column:
    """Order by hash of seed:key, the same on every engine."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: int) -> DataFrame:
    """A sample without replacement by quotas; order is by hash, and so is the sample's final order (column order)."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled_key(seed, F.col(key)), key))
    # a literal bound on the rank lets every task keep but its first rows before the shuffle
    picked = df.withColumn("__rank", rank).where(F.col("__rank") <= size).join(F.broadcast(quotas(df, stratum, size).select(stratum, "quota")), stratum).where("__rank <= quota")  # a row per stratum
    return picked.drop("__rank", "quota").withColumn("sample_order", shuffled_key(seed, F.col(key)))


def nested(df: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Samples within samples, with seeds that count up: a flag for each."""
    pool, out = df, df
    for i, (name, size) in enumerate(sizes.items()):
        pool = stratified(pool, key, stratum, size, seed + i).drop("sample_order")
        out = out.join(pool.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def pruned_candidates(df: DataFrame, key: str, stratum: str, unit: str, wanted: dict[str, int], seed: int) -> DataFrame:
    """The only rows that the greedy choice of :func:`balanced` can take: per (stratum, unit) the first by hash, and per stratum as many as all quotas together."""
    ranked = df.where(F.col(stratum).isin(*wanted)).withColumn("rank_key", shuffled_key(seed, F.col(key)))
    first = F.row_number().over(Window.partitionBy(stratum, unit).orderBy("rank_key", key))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("rank_key", key))
    return ranked.withColumn("__first", first).where("__first = 1").withColumn("place", place).where(F.col("place") <= sum(wanted.values())).drop("__first")


def balanced(df: DataFrame, key: str, stratum: str, unit: str, wanted: dict[str, int], seed: int) -> DataFrame:
    """Round-robin over the strata, each unit at most once. Sequential by nature: only the pruned rows, at most the
    square of the sample's size, reach the driver. Raises where quotas can't be met."""
    rows = pruned_candidates(df, key, stratum, unit, wanted, seed).select(key, stratum, unit, "place").collect()
    queues = {s: iter(sorted((r for r in rows if r[stratum] == s), key=lambda r: r["place"])) for s in wanted}
    taken: set = set()
    chosen: list[tuple] = []
    left = dict(wanted)
    while any(left.values()):
        for s in sorted(left):
            if not left[s]:
                continue
            row = next((r for r in queues[s] if r[unit] not in taken), None)
            if row is None:
                raise ContractError(f"stratum {s!r} can't fill its quota")
            taken.add(row[unit])
            chosen.append((row[key], len(chosen)))
            left[s] -= 1
    kind = df.schema[key].dataType.simpleString()
    picks = df.sparkSession.createDataFrame(chosen, f"{key} {kind}, sample_order long")
    return df.join(F.broadcast(picks), key)  # as many rows as the quotas ask for


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; k must be positive."""
    if k < 1:
        raise ValueError("limit must be positive")
    return df.orderBy(*order).limit(k)


def evenly_spaced(df: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """k rows of each group (by: at least one column) at equal steps of their sorted order."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))  # a row per group
    rows = numbered(df, by, [key]).join(sizes, by)
    step = F.floor(F.col("row_idx") * k / F.col("__n"))
    before = F.floor((F.col("row_idx") - 1) * k / F.col("__n"))
    return rows.where((F.col("row_idx") == 0) | (step > before)).drop("row_idx", "__n")

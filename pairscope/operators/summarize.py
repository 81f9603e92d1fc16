"""Grouped summaries in long form. Rates without a base are NULL, unless a default is named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, default: float | None = None) -> Column:
    found = F.try_divide(part.cast("double"), whole)
    return found if default is None else F.coalesce(found, F.lit(default))


def grouped(df: DataFrame, sets: list[list[str]], metrics: dict[str, Column]) -> DataFrame:
    """One pass over df for several groupings; columns that a grouping lacks read ``(all)``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    agg = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*[F.grouping(c).alias(f"__g_{c}") for c in columns], *[m.alias(n) for n, m in metrics.items()])
    shown = [F.when(F.col(f"__g_{c}") == 1, "(all)").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("(null)"))).alias(c) for c in columns]
    return agg.select(*shown, *metrics)


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def transitions(first: Column, second: Column) -> dict[str, Column]:
    """The four cells of two paired booleans, zeros included."""
    return {"both": F.count_if(first & second), "first_only": F.count_if(first & ~second), "second_only": F.count_if(~first & second), "neither": F.count_if(~first & ~second)}


def signs(value: Column) -> dict[str, Column]:
    """Counts of signs, the rate of positive ones among all and among those that aren't 0."""
    up, down = F.count_if(value > 0), F.count_if(value < 0)
    return {"n": F.count(value), "positive": up, "negative": down, "zero": F.count_if(value == 0), "positive_rate": rate(up, F.count(value)), "nonzero_positive_rate": rate(up, up + down, 0.0)}


def verdicts(verdict: Column) -> dict[str, Column]:
    good, bad = F.count_if(verdict == "correct"), F.count_if(verdict == "incorrect")
    return {"n": F.count(F.lit(1)), "correct": good, "incorrect": bad, "uncertain": F.count_if(verdict == "uncertain"), "rate_all": rate(good, F.count(F.lit(1))), "rate_decisive": rate(good, good + bad)}


def effects(effect: Column) -> dict[str, Column]:
    helps, harms = F.count_if(effect == "helps"), F.count_if(effect == "harms")
    return {"n": F.count(F.lit(1)), "helps": helps, "harms": harms, "tie": F.count_if(effect == "tie"), "uncertain": F.count_if(effect == "uncertain"), "helps_per_harm": rate(helps, harms)}


def confusion(truth: Column, guess: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (F.count_if(a & b) for a, b in ((truth, guess), (~truth, guess), (truth, ~guess), (~truth, ~guess)))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "accuracy": rate(tp + tn, tp + fp + fn + tn)}


def policy(selected: Column, before: Column, after: Column, no_harm: float | None = 1.0) -> dict[str, Column]:
    """A policy's utility and what it captures: helpful cases selected, harmful ones avoided (no_harm where there are none)."""
    helpful, harmful = after > before, after < before
    chosen = F.when(selected, after).otherwise(before).cast("double")
    return {
        "n": F.count(F.lit(1)),
        "selected": F.count_if(selected),
        "selection_rate": rate(F.count_if(selected), F.count(F.lit(1))),
        "utility": F.avg(chosen),
        "utility_before": F.avg(before.cast("double")),
        "utility_after": F.avg(after.cast("double")),
        "oracle": F.avg(F.greatest(before, after).cast("double")),
        "capture": rate(F.count_if(selected & helpful), F.count_if(helpful)),
        "harm_avoidance": rate(F.count_if(harmful & ~selected), F.count_if(harmful), no_harm),
    }


def best_of(array: Column, metric) -> Column:
    return F.array_max(F.transform(array, metric))


def coverage(available: Column) -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "available": F.count_if(available), "coverage": rate(F.count_if(available), F.count(F.lit(1)))}


def failed(df: DataFrame, available: Column, key: str, by: list[str]) -> DataFrame:
    """The keys that coverage() misses, a row each, sorted within their groups."""
    return df.where(~F.coalesce(available, F.lit(False))).select(*by, key).orderBy(*by, key)


def filled_categories(df: DataFrame, column: str, categories: list[str], metrics: dict[str, Column]) -> DataFrame:
    """A row for each category, also those without rows: their counts are 0."""
    dimension = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    counts = df.where(F.col(column).isin(categories)).groupBy(column).agg(*[m.alias(n) for n, m in metrics.items()])
    return F.broadcast(dimension).join(counts, column, "left").select(column, *[F.coalesce(n, F.lit(0)).alias(n) for n in metrics])


def with_and_without(df: DataFrame, excluded: Column, metrics: dict[str, Column]) -> DataFrame:
    """The summary of all rows and of those that aren't excluded."""
    named = F.inline(F.array(F.struct(F.lit("all").alias("variant"), F.lit(True).alias("__held")), F.struct(F.lit("confirmed").alias("variant"), (~excluded).alias("__held"))))
    return df.select("*", named).where("__held").groupBy("variant").agg(*[m.alias(n) for n, m in metrics.items()])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

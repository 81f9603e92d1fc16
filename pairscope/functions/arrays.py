"""Array kernels: log-probability statistics and features of score variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def logprob_statistics(values: Column) -> dict[str, Column]:
    """Of an array of log-probabilities: count, sum, mean, range and perplexity (the exponent is capped at 80). NULL for an empty one."""
    n = F.size(values)
    mean = F.try_divide(_sum(values), n)
    return {"n": n, "total": F.when(n > 0, _sum(values)), "mean": mean, "low": F.array_min(values), "high": F.array_max(values), "perplexity": F.exp(F.least(F.lit(80.0), -mean))}


def nonzero_statistics(values: Column) -> dict[str, Column]:
    """Sum and mean of the values that aren't 0; NULL if none."""
    held = F.filter(values, lambda x: x != 0)
    return {"total": F.when(F.size(held) > 0, _sum(held)), "mean": F.try_divide(_sum(held), F.size(held))}


def variant_features(variants: Column, reference: Column) -> dict[str, Column]:
    """Of scores of variants (the identity first) against one reference score: their deltas' statistics."""
    deltas = F.transform(variants, lambda x: x - reference)
    n = F.size(deltas)
    mean = _sum(deltas) / n
    identity = F.get(deltas, 0)
    spread = F.sqrt(F.aggregate(deltas, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return {
        "identity": identity,
        "mean": mean,
        "low": F.array_min(deltas),
        "high": F.array_max(deltas),
        "std_pop": spread,
        "spread": F.array_max(deltas) - F.array_min(deltas),
        "worst_drop": identity - F.array_min(deltas),
        "max_abs": F.array_max(F.transform(deltas, F.abs)),
        "positive_fraction": F.size(F.filter(deltas, lambda x: x > 0)) / n,
        "sign_consistency": F.size(F.filter(deltas, lambda x: F.signum(x) == F.signum(identity))) / n,
    }

"""Rank, exact and resampling statistics, declared over grouped DataFrames.

Each function takes the columns that name groups (possibly none) and gives a row per group. Undefined values are NULL.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators.ordering import numbered, running_sums

LOG_HALF = log(0.5)


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve with ties as one half, from running sums over the distinct scores."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label), 0).otherwise(1)).alias("n"))
    ranked = running_sums(counts, by, [F.col(score)], ["n"])
    sums = ranked.groupBy(*by).agg(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return sums.select(*by, "n_positive", "n_negative", F.try_divide(F.col("wins"), F.col("n_positive") * F.col("n_negative")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Sum over distinct scores, from above, of the gain in recall times the precision."""
    counts = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label), 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("rows"))
    steps = running_sums(counts, by, [F.desc(score)], ["p", "rows"])
    precision = (F.col("p_before") + F.col("p")) / (F.col("rows_before") + F.col("rows"))
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * precision), F.sum("p").cast("double")).alias("average_precision"))


def exact_two_sided(first: Column, second: Column) -> Column:
    """Exact sign test (McNemar's on discordant pairs): min(1, 2 P(X <= min)) for X ~ B(first + second, 1/2), in logarithms; 1 if there are none."""
    n, low = (first + second).cast("int"), F.least(first, second).cast("int")
    # log C(n, i + 1) = log C(n, i) + log(n - i) - log(i + 1)
    step = F.aggregate(
        F.sequence(F.lit(0), low),
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["c"] + F.when(i < n, F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).otherwise(F.lit(0.0))).alias("c"), (s["total"] + F.exp(s["c"] + n * LOG_HALF)).alias("total")),
        lambda s: s["total"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * step))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL for fewer than two rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))))


def draw(seed: Column | str | int, replicate: Column, place: Column, n: Column) -> Column:
    """A pseudo-random index below n from md5(seed:replicate:place): equal on every engine and partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", seed, replicate.cast("string"), place.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long"))


def resampled(df: DataFrame, order: list[str], seed: int, replicates: int, by: list[str]) -> DataFrame:
    """Bootstrap samples with replacement within each group of by: replicate, then df's columns.

    Rows are numbered per group by order. Each row makes the draws of its own place, one a replicate, so draws are
    spread as the rows are; a draw then joins the row that it fell on."""
    rows = numbered(df, by, order).withColumnRenamed("row_idx", "__i")
    if by:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        placed = rows.select(*by, F.col("__i").alias("__place")).join(sizes, by)
    else:
        placed = rows.select(F.col("__i").alias("__place")).withColumn("__n", F.lit(rows.count()))
    where = F.concat_ws("|", F.lit(str(seed)), *[F.col(b).cast("string") for b in by])
    draws = placed.select(*by, "__place", "__n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select(*by, "replicate", draw(where, F.col("replicate"), F.col("__place"), F.col("__n")).alias("__i"))
    return drawn.join(rows, [*by, "__i"]).drop("__i")


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group the quantiles of value, interpolated between neighbours, as columns named by shares. NULLs don't count.

    From row numbers, so no task holds a group's values; the aggregate functions are for groups of bounded size."""
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    rows = numbered(own, by, ["__v"])
    if by:
        rows = rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    else:
        rows = rows.withColumn("__n", F.lit(rows.count()))
    cells, wanted = [], F.lit(False)
    for name, share in shares.items():
        at = (F.col("__n") - 1) * F.lit(float(share))
        part = at - F.floor(at)
        low, high = F.col("row_idx") == F.floor(at), F.col("row_idx") == F.ceil(at)
        wanted = wanted | low | high
        ends = [F.max(F.when(x, F.col("__v"))) for x in (low, high)]
        cells.append((ends[0] + (ends[1] - ends[0]) * F.max(part)).alias(name))
    return rows.where(wanted).groupBy(*by).agg(*cells)


def one_class(label: str) -> Column:
    """Whether all rows of a group have one label, so that ranking them means nothing."""
    return F.bool_and(label) | F.bool_and(~F.col(label))


def interval(df: DataFrame, value: str, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of replicates' values, of which there are as many as were asked for; those where the value is undefined are skipped and not counted."""
    return df.groupBy(*by).agg(F.count(value).alias("valid_resamples"), F.percentile(value, low).alias("ci_low"), F.percentile(value, high).alias("ci_high"))


def group_draws(df: DataFrame, group: str, seed: int, replicates: int) -> DataFrame:
    """Cluster bootstrap: groups drawn with replacement, then joined back to their rows with multiplicity."""
    groups = df.select(group).distinct()
    drawn = resampled(groups, [group], seed, replicates, [])
    return drawn.join(df, group)


def metric_intervals(drawn: DataFrame, score: str, label: str | None, by: list[str]) -> DataFrame:
    """Intervals over the replicates of drawn (replicate, score, label): metric, valid_resamples, ci_low, ci_high, per group of by.

    The mean; with a boolean label also auroc and average_precision, which skip replicates of one class."""
    keys = [*by, "replicate"]
    found = drawn.groupBy(*keys).agg(F.avg(score).alias("value")).select(*keys, F.lit("mean").alias("metric"), "value")
    if label is not None:
        mixed = drawn.join(drawn.groupBy(*keys).agg(one_class(label).alias("__one")).where("NOT __one").drop("__one"), keys)
        for name, function in (("auroc", auroc), ("average_precision", average_precision)):
            found = found.unionByName(function(mixed, score, label, keys).select(*keys, F.lit(name).alias("metric"), F.col(name).alias("value")))
    return interval(found, "value", [*by, "metric"])


def paired_intervals(drawn: DataFrame, first: str, second: str, label: str | None, by: list[str]) -> DataFrame:
    """As metric_intervals, of the difference first - second of two scores on the same draws: of the mean, and with a label of auroc."""
    keys = [*by, "replicate"]
    found = drawn.groupBy(*keys).agg(F.avg(F.col(first) - F.col(second)).alias("value")).select(*keys, F.lit("mean").alias("metric"), "value")
    if label is not None:
        a, b = (auroc(drawn, x, label, keys).select(*keys, F.col("auroc").alias(n)) for x, n in ((first, "__a"), (second, "__b")))
        found = found.unionByName(a.join(b, keys).select(*keys, F.lit("auroc").alias("metric"), (F.col("__a") - F.col("__b")).alias("value")))
    return interval(found, "value", [*by, "metric"])


def unpivoted(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keep, features, "feature", "value")


def alignment(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """How a score goes with a binary label: auroc with the classes' sizes, and the classes' mean scores."""
    y = F.col(label)
    means = df.where(y.isNotNull()).groupBy(*by).agg(F.avg(F.when(y, F.col(score))).alias("mean_positive"), F.avg(F.when(~y, F.col(score))).alias("mean_negative"))
    return auroc(df, score, label, by).join(means, by)


def describe(value: Column) -> dict[str, Column]:
    """Count, mean, median, population deviation and range. The median holds a group's distinct values; :func:`quantiles` doesn't."""
    return {"n": F.count(value), "mean": F.avg(value), "median": F.median(value), "std_pop": F.stddev_pop(value), "low": F.min(value), "high": F.max(value)}


def distribution(value: Column) -> dict[str, Column]:
    """Mean, sample deviation, quartiles and range. Quartiles hold a group's distinct values; :func:`quantiles` doesn't."""
    return {"mean": F.avg(value), "std_samp": F.stddev_samp(value), "median": F.median(value), "q25": F.percentile(value, 0.25), "q75": F.percentile(value, 0.75), "low": F.min(value), "high": F.max(value)}


def threshold_choice(df: DataFrame, probability: str, before: str, after: str, by: list[str]) -> DataFrame:
    """The cut on probability that maximises mean utility, then the lowest selection rate, then the highest cut.

    Candidates: 0, every distinct probability, and above 1 (nothing selected). Running sums instead of a scan per cut."""
    if not by:
        return threshold_choice(df.withColumn("__all", F.lit(1)), probability, before, after, ["__all"]).drop("__all")
    gains = df.groupBy(*by, probability).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(after) - F.col(before)).alias("gain"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(before).cast("double")).alias("base"), F.sum(F.col(after).cast("double")).alias("all_after"))
    above = running_sums(gains, by, [F.desc(probability)], ["rows", "gain"])
    cuts = above.select(*by, F.col(probability).cast("double").alias("threshold"), (F.col("rows_before") + F.col("rows")).alias("picked"), (F.col("gain_before") + F.col("gain")).cast("double").alias("gain"))
    ends = total.select(*by, F.inline(F.array(F.struct(F.lit(0.0).alias("threshold"), F.col("n").alias("picked"), (F.col("all_after") - F.col("base")).alias("gain")), F.struct(F.lit(1.0000000000000002).alias("threshold"), F.lit(0).cast("long").alias("picked"), F.lit(0.0).alias("gain")))))
    every = cuts.unionByName(ends)
    scored = every.join(total, by).select(*by, "threshold", (F.col("picked") / F.col("n")).alias("selection_rate"), ((F.col("base") + F.col("gain")) / F.col("n")).alias("utility"))
    best = F.max(F.struct("utility", (-F.col("selection_rate")).alias("less"), "threshold")).alias("best")
    return scored.groupBy(*by).agg(best).select(*by, F.col("best.threshold").alias("threshold"), F.col("best.utility").alias("utility"), (-F.col("best.less")).alias("selection_rate"))

"""Selection policies: when to intervene, learned without leaking groups between training and test rows.

Folds are dealt over all rows' groups in DataFrame operations. A model is fitted on a sample of at most FIT_ROWS rows,
whole groups chosen by their hash: parallelism lies across tasks (feature set, repeat, fold), which are the rows of a
DataFrame, and each worker gets the sample once. Models come back as rows; every row of the table is then scored by a
column expression.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators import contracts as C
from pairscope.operators import stats
from pairscope.operators.ordering import numbered

#: Rows that a model is fitted on, at most.
FIT_ROWS = 100_000
#: Seeds that are tried for folds whose training parts all have both classes.
TRIES = 100
PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


def prepare(df: DataFrame, features: list[str], target: str, before: str, after: str) -> DataFrame:
    """Aligned rows: features as an array, target and utilities; features must be finite and each class have two rows."""
    C.assert_empty(C.not_finite(df, features), "features must be finite")
    C.assert_empty(C.small_classes(df, target), "each class needs two rows")
    return df.withColumn("features", F.array(*[F.col(f).cast("double") for f in features])).withColumn("utility_gain", F.col(after) - F.col(before))


def policy_utility(selected: Column, before: Column, after: Column) -> Column:
    return F.when(selected, after).otherwise(before)


def standardized(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Features less the training rows' mean, by their population deviation (by 1 where that is 0)."""
    found = df.where(train).agg(*[F.avg(f).alias(f"{f}__mean") for f in features], *[F.stddev_pop(f).alias(f"{f}__std") for f in features]).first()
    return df.select(*[c for c in df.columns if c not in features], *[((F.col(f) - F.lit(found[f"{f}__mean"])) / F.lit(found[f"{f}__std"] or 1.0)).alias(f) for f in features])


def fit(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """L2 logistic regression with balanced classes and a penalised intercept (last weight), by Newton steps."""
    full = np.hstack([x, np.ones((len(x), 1))])
    balance = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    w = np.zeros(full.shape[1])

    def loss(v: np.ndarray) -> float:
        z = full @ v
        return 0.5 * v @ v + c * float((balance * (np.logaddexp(0, z) - y * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -500, 500)))
        slope = w + c * (full.T @ (balance * (p - y)))
        curve = np.eye(len(w)) + c * (full.T * (balance * p * (1 - p))) @ full
        step, scale, here = np.linalg.solve(curve, slope), 1.0, loss(w)
        while loss(w - scale * step) > here and scale > 1e-8:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-10:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


def _scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    mean, std = train.mean(axis=0), train.std(axis=0)
    std = np.where(std == 0, 1, std)
    return [(a - mean) / std for a in (train, *others)]


def group_folds(y: np.ndarray, groups: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A fold per row: groups stay whole, classes balanced, every training part has both classes; up to 100 seeds are tried."""
    names, index = np.unique(groups.astype(str), return_inverse=True)
    counts = np.stack([np.bincount(index, weights=y == v, minlength=len(names)) for v in (0, 1)], axis=1)
    for trial in range(seed, seed + 100):
        ticket = [hashlib.sha256(f"{trial}|{n}".encode()).hexdigest() for n in names]
        order = sorted(range(len(names)), key=lambda g: (-abs(counts[g, 0] - counts[g, 1]), -counts[g].sum(), ticket[g]))
        held, fold = np.zeros((k, 2)), np.zeros(len(names), dtype=int)
        total = np.maximum(counts.sum(axis=0), 1)
        for g in order:
            spread = [(((held + counts[g] * (np.arange(k) == f)[:, None]) / total).std(axis=0).sum(), held[f].sum(), f) for f in range(k)]
            fold[g] = min(spread)[2]
            held[fold[g]] += counts[g]
        rows = fold[index]
        if all(len(np.unique(y[rows != f])) == 2 and (rows == f).any() for f in range(k)):
            return rows
    raise C.ContractError("no split has both classes in every training part")


def oof(x: np.ndarray, y: np.ndarray, groups: np.ndarray, k: int, seed: int, c: float) -> np.ndarray:
    """Out-of-fold probabilities over group folds."""
    fold, out = group_folds(y, groups, k, seed), np.zeros(len(y))
    for f in range(k):
        train, test = _scaled(x[fold != f], x[fold == f])
        out[fold == f] = predict(fit(train, y[fold != f], c), test)
    return out


def average_precision(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    last = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    hits = np.cumsum(y[order])[last]
    return float((np.diff(np.append(0, hits)) * hits / (last + 1)).sum() / max(y.sum(), 1))


def threshold(p: np.ndarray, before: np.ndarray, after: np.ndarray) -> float:
    """As stats.threshold_choice, for arrays: best mean utility, then fewest selected, then the highest cut; by one sort and running sums."""
    order = np.argsort(-p, kind="stable")
    last = np.append(np.flatnonzero(np.diff(p[order])), len(p) - 1)
    gain = np.cumsum(after[order] - before[order])[last]
    cuts = np.concatenate([[np.nextafter(1, 2)], p[order][last], [0.0]])
    picked = np.concatenate([[0], last + 1, [len(p)]])
    utility = np.round((before.sum() + np.concatenate([[0.0], gain, gain[-1:]])) / len(p), 12)
    return float(cuts[np.lexsort((cuts, -picked, utility))[-1]])


@dataclass(frozen=True)
class Study:
    """How a selector is validated: columns, folds, repeats and the penalties tried."""

    features: dict[str, tuple[str, ...]]
    target: str = "target"
    before: str = "before"
    after: str = "after"
    group: str = "group"
    key: str = "id"
    folds: int = 5
    inner: int = 3
    repeats: int = 2
    seed: int = 42
    penalties: tuple[float, ...] = PENALTIES


def fold_groups(df: DataFrame, group: str, target: str, k: int, seeds: list[int]) -> DataFrame:
    """Per group of df: group and folds, an array with a fold for each seed. Groups stay whole.

    Groups with like counts of both classes make a profile (counts above 16 are rounded to four bits, so profiles are
    few); a profile's groups are dealt over the folds in turn, in the order of a hash, from the fold where that
    balances the classes best. A seed whose folds leave a training part with one class, or a fold empty, is replaced by
    the next one, TRIES times. With the key as group, this is stratified K-fold."""
    y = F.col(target).cast("int")
    counts = df.groupBy(group).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    counts = counts.withColumn("profile", F.concat_ws("/", _rough("n0"), _rough("n1")))
    kinds = counts.groupBy("profile").agg(F.count(F.lit(1)).alias("groups"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
    done: dict[int, DataFrame] = {}
    open_ = {i: seed for i, seed in enumerate(seeds)}
    for _ in range(TRIES):
        asked = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f"{seed}|").alias("lead")) for i, seed in open_.items()])
        tall = counts.select("*", F.inline(asked)).withColumn("ticket", F.sha2(F.concat(F.col("lead"), F.col(group).cast("string")), 256))
        starts = [(i, kind, start) for i, seed in open_.items() for kind, start in _starts(kinds, k, seed).items()]
        first = F.broadcast(df.sparkSession.createDataFrame(starts, "place int, profile string, start int"))  # a row per profile and seed
        dealt = numbered(tall, ["place", "profile"], ["ticket"]).join(first, ["place", "profile"])
        dealt = dealt.select("place", group, "n0", "n1", ((F.col("row_idx") + F.col("start")) % k).cast("int").alias("fold"))
        held = {i: np.zeros((k, 2)) for i in open_}
        for r in dealt.groupBy("place", "fold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
            held[r["place"]][r["fold"]] = (r["n0"], r["n1"])
        for i, each in held.items():
            if ((each.sum(axis=0) - each) > 0).all() and (each.sum(axis=1) > 0).all():
                done[i] = dealt.where(F.col("place") == i)
        open_ = {i: seed + 1 for i, seed in open_.items() if i not in done}
        if not open_:
            break
    else:
        raise C.ContractError("no split has both classes in every training part")
    tall = None
    for part in done.values():
        tall = part if tall is None else tall.unionByName(part)
    return tall.groupBy(group).agg(F.array(*[F.max(F.when(F.col("place") == i, F.col("fold"))) for i in range(len(seeds))]).alias("folds"))


def _rough(column: str) -> Column:
    """A count in four bits and an exponent."""
    n = F.col(column)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 3, F.lit(0))).cast("long")
    return (n - n % unit).cast("string")


def _starts(kinds: list, k: int, seed: int) -> dict[str, int]:
    """The fold at which each profile's dealing starts: large groups first, each where the classes' shares spread least."""
    total = np.maximum(np.sum([[r["n0"], r["n1"]] for r in kinds], axis=0), 1)
    held, out = np.zeros((k, 2)), {}
    for r in sorted(kinds, key=lambda r: (-(r["n0"] + r["n1"]) / r["groups"], r["profile"])):
        each = np.array([r["n0"], r["n1"]]) / r["groups"]
        even, rest = divmod(r["groups"], k)

        def after(start: int, even: int = even, rest: int = rest, each: np.ndarray = each) -> np.ndarray:
            more = np.full(k, float(even))
            more[(start + np.arange(rest)) % k] += 1
            return held + more[:, None] * each

        start = min(((f + seed) % k for f in range(k)), key=lambda f: round(float((after(f) / total).std(axis=0).sum()), 12))
        held = after(start)
        out[r["profile"]] = start
    return out


def sample(df: DataFrame, columns: list[str], group: str, key: str) -> pd.DataFrame:
    """At most FIT_ROWS rows of df, in an order of their own: whole groups, as far as they fit, chosen by their hash."""
    n = df.count()
    of_group = F.xxhash64(F.col(group).cast("string"))
    kept = df if n <= FIT_ROWS else df.where(F.pmod(of_group, F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / n))
    slim = kept.select(*dict.fromkeys([*columns, group, key]), of_group.alias("__first"), F.xxhash64(F.col(key).cast("string")).alias("__second"))
    return slim.orderBy("__first", F.col(group).cast("string"), "__second", F.col(key).cast("string")).limit(FIT_ROWS).drop("__first", "__second").toPandas()


def _columns(study: Study) -> list[str]:
    return [study.target, study.before, study.after, *[f for s in study.features.values() for f in s]]


def _tasks(df: DataFrame, shared: object, tasks: list[tuple], names: str, function: Callable, schema: str) -> DataFrame:
    """A row per task, made by function(shared, *task) on the executors."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(shared)  # at most FIT_ROWS rows
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [function(held.value, *task) for task in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=columns)

    todo = spark.createDataFrame(tasks, names)
    return todo.repartition(len(tasks), *todo.columns).mapInPandas(run, schema)


MODEL = "penalty double, threshold double, mean array<double>, std array<double>, weights array<double>"


def _model(x: np.ndarray, y: np.ndarray, c: float) -> tuple[list, list, list]:
    """Scaling and weights of a fit."""
    std = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    return x.mean(axis=0).tolist(), std.tolist(), fit(_scaled(x)[0], y, c).tolist()


def _score(features: Column, mean: Column, std: Column, weights: Column) -> Column:
    """The probability by a model's arrays."""
    places = F.sequence(F.lit(0), F.size(mean) - 1)
    total = F.aggregate(places, F.lit(0.0), lambda z, i: z + (F.get(features, i) - F.get(mean, i)) / F.get(std, i) * F.get(weights, i))
    return 1 / (1 + F.exp(-(total + F.element_at(weights, -1))))


def _array(features: tuple[str, ...]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def best_penalty(x: np.ndarray, y: np.ndarray, groups: np.ndarray, study: Study, seed: int) -> float:
    """The penalty with the best out-of-fold average precision; ties go to the smaller."""
    return max(study.penalties, key=lambda c: (round(average_precision(oof(x, y, groups, study.inner, seed, c), y), 12), -c))


def fitted(df: DataFrame, features: tuple[str, ...], target: str, group: str, key: str, c: float) -> DataFrame:
    """A fit on standardised features as rows (term, weight), the intercept last; made by a task."""
    rows = sample(df, [*features, target], group, key)

    def run(rows: pd.DataFrame, c: float) -> tuple:
        return (_model(rows[list(features)].to_numpy(dtype=float), rows[target].to_numpy(dtype=int), c)[2],)

    names = F.array(*[F.lit(n) for n in (*features, "intercept")])
    found = _tasks(df, rows, [(c,)], "c double", run, "weights array<double>")
    return found.select(F.inline(F.arrays_zip(names.alias("term"), F.col("weights").alias("weight"))))


def out_of_fold(df: DataFrame, features: tuple[str, ...], target: str, group: str, key: str, k: int, seed: int, c: float) -> DataFrame:
    """Every row's probability (key, fold, probability) by a model that was fitted without its fold's groups."""
    placed = df.join(fold_groups(df, group, target, k, [seed]), group).withColumn("fold", F.get("folds", 0))
    rows = sample(placed, [*features, target, "fold"], group, key)

    def run(rows: pd.DataFrame, fold: int) -> tuple:
        train = rows[rows["fold"] != fold]
        return (fold, *_model(train[list(features)].to_numpy(dtype=float), train[target].to_numpy(dtype=int), c))

    models = _tasks(df, rows, [(f,) for f in range(k)], "fold int", run, "fold int, mean array<double>, std array<double>, weights array<double>")
    return placed.join(F.broadcast(models), "fold").select(key, "fold", _score(_array(features), F.col("mean"), F.col("std"), F.col("weights")).alias("probability"))  # a model a fold


def penalty_scores(df: DataFrame, study: Study, name: str, seed: int) -> DataFrame:
    """Per penalty its out-of-fold average precision on the sample: penalty, average_precision. A task a penalty."""
    rows = sample(df, _columns(study), study.group, study.key)

    def run(rows: pd.DataFrame, c: float) -> tuple:
        x, y = rows[list(study.features[name])].to_numpy(dtype=float), rows[study.target].to_numpy(dtype=int)
        return c, average_precision(oof(x, y, rows[study.group].to_numpy(), study.inner, seed, c), y)

    return _tasks(df, rows, [(float(c),) for c in study.penalties], "c double", run, "penalty double, average_precision double")


def chosen_penalty(scores: DataFrame) -> DataFrame:
    """The penalty of the best average precision; ties go to the smaller."""
    return scores.agg(F.max_by("penalty", F.struct(F.round("average_precision", 12), -F.col("penalty"))).alias("penalty"))


def nested_cv(df: DataFrame, study: Study) -> DataFrame:
    """Out-of-fold decisions of every feature set and repeat: feature_set, repeat, fold, key, probability, selected, penalty, threshold.

    Within each outer fold, the penalty and the threshold come from inner folds of the training groups alone."""
    seeds = [study.seed + 1000 * r for r in range(study.repeats)]
    placed = df.join(fold_groups(df, study.group, study.target, study.folds, seeds), study.group)
    rows = sample(placed, [*_columns(study), "folds"], study.group, study.key)

    def run(rows: pd.DataFrame, name: str, r: int, f: int) -> tuple:
        train = rows[np.array([x[r] for x in rows["folds"]], dtype=int) != f]
        x, y, groups = train[list(study.features[name])].to_numpy(dtype=float), train[study.target].to_numpy(dtype=int), train[study.group].to_numpy()
        seed = seeds[r] + f + 1
        c = best_penalty(x, y, groups, study, seed)
        cut = threshold(oof(x, y, groups, study.inner, seed, c), train[study.before].to_numpy(dtype=float), train[study.after].to_numpy(dtype=float))
        return (name, r, f, c, cut, *_model(x, y, c))

    tasks = [(name, r, f) for name in study.features for r in range(study.repeats) for f in range(study.folds)]
    models = _tasks(df, rows, tasks, "feature_set string, repeat int, fold int", run, f"feature_set string, repeat int, fold int, {MODEL}")
    every = placed.select("*", F.posexplode("folds").alias("repeat", "fold")).join(F.broadcast(models), ["repeat", "fold"])  # a model a task
    probability = None
    for name, features in study.features.items():
        own = _score(_array(features), F.col("mean"), F.col("std"), F.col("weights"))
        probability = F.when(F.col("feature_set") == name, own) if probability is None else probability.when(F.col("feature_set") == name, own)
    scored = every.select("feature_set", "repeat", "fold", study.key, probability.alias("probability"), "penalty", "threshold")
    return scored.select("feature_set", "repeat", "fold", study.key, "probability", (F.col("probability") >= F.col("threshold")).alias("selected"), "penalty", "threshold")


@dataclass(frozen=True)
class Frozen:
    """A selector to apply to other rows: scaling, weights and threshold."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def probability(self) -> Column:
        """The score as a column expression; no Python runs where rows are scored."""
        total = F.lit(self.weights[-1])
        for f, m, s, w in zip(self.features, self.mean, self.std, self.weights, strict=False):
            total = total + (F.col(f) - F.lit(m)) / F.lit(s) * F.lit(w)
        return 1 / (1 + F.exp(-total))


def freeze(df: DataFrame, study: Study, name: str) -> Frozen:
    """The threshold from the mean of repeated out-of-fold probabilities, then a fit on all of the sample. Fits are tasks."""
    c = float(chosen_penalty(penalty_scores(df, study, name, study.seed)).first()["penalty"])
    rows = sample(df, _columns(study), study.group, study.key)
    features = tuple(study.features[name])

    def run(rows: pd.DataFrame, repeat: int) -> tuple:
        x, y = rows[list(features)].to_numpy(dtype=float), rows[study.target].to_numpy(dtype=int)
        if repeat < 0:
            return (repeat, *_model(x, y, c))
        return repeat, oof(x, y, rows[study.group].to_numpy(), study.folds, study.seed + 1000 * repeat, c).tolist(), [], []

    found = _tasks(df, rows, [(r,) for r in range(-1, study.repeats)], "r int", run, "repeat int, mean array<double>, std array<double>, weights array<double>").collect()
    model = next(r for r in found if r["repeat"] < 0)
    mean = np.mean([r["mean"] for r in found if r["repeat"] >= 0], axis=0)
    cut = threshold(mean, rows[study.before].to_numpy(dtype=float), rows[study.after].to_numpy(dtype=float))
    return Frozen(features, tuple(model["mean"]), tuple(model["std"]), tuple(model["weights"]), cut)


def transfer(source: DataFrame, target: DataFrame, study: Study, name: str) -> DataFrame:
    """A selector frozen on source rows whose groups aren't in target, applied to target."""
    own = source.join(target.select(study.group).distinct(), study.group, "left_anti")
    C.assert_empty(C.leaked_groups(own, target, study.group), "groups leak into the target")
    frozen = freeze(own, study, name)
    scored = target.withColumn("probability", frozen.probability())
    return scored.withColumn("selected", F.col("probability") >= frozen.threshold)


def majority(decisions: DataFrame, key: str) -> DataFrame:
    """Per feature set and row, whether at least half of the repeats select it, and the mean probability."""
    return decisions.groupBy("feature_set", key).agg(F.avg("probability").alias("probability"), (F.avg(F.col("selected").cast("double")) >= 0.5).alias("selected"))


def compare_sets(decisions: DataFrame, rows: DataFrame, key: str, target: str, before: str | None = None, after: str | None = None, seed: int = 42, replicates: int = 0) -> DataFrame:
    """All pairs of feature sets: first, second and the gain in AUROC of the second over the first.

    With replicates, two rows a pair (metric auroc, and mean of the policies' expected utility): the gain, and the interval
    of the difference on the same draws."""
    scores = majority(decisions, key).join(rows.select(key, target), key)
    found = stats.auroc(scores, "probability", target, ["feature_set"]).select("feature_set", "auroc")
    a, b = found.alias("a"), found.alias("b")
    pairs = a.join(b, F.col("a.feature_set") < F.col("b.feature_set")).select(F.col("a.feature_set").alias("first"), F.col("b.feature_set").alias("second"), (F.col("b.auroc") - F.col("a.auroc")).alias("gain"))
    if not replicates:
        return pairs
    utility = F.when(F.col("selected"), F.col(after)).otherwise(F.col(before)).cast("double")
    each = decisions.join(rows.select(key, target, before, after), key).groupBy("feature_set", key, target).agg(F.avg("probability").alias("p"), F.avg(utility).alias("u"))
    one, two = (each.select(F.col("feature_set").alias(n), key, target, F.col("p").alias(f"p_{n}"), F.col("u").alias(f"u_{n}")) for n in ("first", "second"))
    both = one.join(two.drop(target), key).where("first < second")
    drawn = stats.resampled(both, [key], seed, replicates, ["first", "second"])
    keys, limits = ["first", "second"], []
    for metric, name in (("auroc", "p"), ("mean", "u")):
        label = target if metric == "auroc" else None
        limits.append(stats.paired_intervals(drawn, f"{name}_second", f"{name}_first", label, keys).where(F.col("metric") == metric))
    means = both.groupBy(*keys).agg(F.avg(F.col("u_second") - F.col("u_first")).alias("gain"))
    gains = pairs.withColumn("metric", F.lit("auroc")).unionByName(means.withColumn("metric", F.lit("mean")))
    return gains.join(limits[0].unionByName(limits[1]), [*keys, "metric"])


def by_stratum(scored: DataFrame, stratum: str, key: str, before: str, after: str, seed: int, replicates: int) -> DataFrame:
    """A frozen policy on other rows (with selected), per stratum: its metrics, and the intervals of its utility and of its gain over before."""
    from pairscope.operators import summarize as S

    found = S.policy(F.col("selected"), F.col(before), F.col(after), None)
    chosen = F.when(F.col("selected"), F.col(after)).otherwise(F.col(before)).cast("double")
    rows = scored.select(stratum, key, chosen.alias("__u"), F.col(before).cast("double").alias("__b"))
    drawn = stats.resampled(rows, [key], seed, replicates, [stratum])
    utility = stats.metric_intervals(drawn, "__u", None, [stratum]).select(stratum, "valid_resamples", F.col("ci_low").alias("utility_low"), F.col("ci_high").alias("utility_high"))
    gain = stats.paired_intervals(drawn, "__u", "__b", None, [stratum]).select(stratum, F.col("ci_low").alias("gain_low"), F.col("ci_high").alias("gain_high"))
    return scored.groupBy(stratum).agg(*[c.alias(n) for n, c in found.items()]).join(utility, stratum).join(gain, stratum)


def go_no_go(gain: Column, policy_gain: Column, wins: Column, least_gain: float, least_policy: float, least_wins: float) -> Column:
    """conditional_go where all three reach their thresholds; undefined counts as not reached."""
    held = (gain >= least_gain) & (policy_gain >= least_policy) & (wins >= least_wins)
    return F.when(F.coalesce(held, F.lit(False)), "conditional_go").otherwise("no_go")

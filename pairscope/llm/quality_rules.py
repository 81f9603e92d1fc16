"""Quality scores by a sparse rule ensemble.

Small boosted trees are grown on document statistics; each path from a root becomes a conjunctive rule; a lasso
logistic regression weighs the rules and drops most; the rest is compiled into one Spark column expression.

The ensemble is fitted on a bounded, documented sample (MOST_ROWS labelled documents, chosen by a hash of
doc_id); statistics and scores cover every document's whole text.

Defined results: a null text counts as empty, and empty texts are scored by their statistics like others; a
document with several label rows counts once for each; without training rows every score is 0.5, with labels of
one kind it is that label; a null doc_id is never held out and never trained on; repeated rows are scored alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import common
from pairscope.llm.common import saved, table

#: Bound of the training sample.
MOST_ROWS = 20_000
TREES, DEPTH, SHRINK, LEAST, BINS = 24, 3, 0.3, 20, 32
PENALTY, ROUNDS = 0.002, 400
THRESHOLD = 0.3

STATISTICS = ("log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "marks", "pipes", "bangs", "symbols", "stops", "non_ascii", "lines", "distinct", "top_word", "repeats", "short_words", "capitals")
_CLASSES = {
    "upper": range(0x41, 0x5B),
    "digits": range(0x30, 0x3A),
    "marks": [x for x in range(0x21, 0x7F) if not chr(x).isalnum()],
    "pipes": b"|",
    "bangs": b"!?",
    "symbols": b"#$%&*@^~<>{}[]\\=+_",
    "stops": b".,;:",
    "non_ascii": range(0x80, 0x100),
    "lines": b"\n",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of docs (doc_id, text)."""
    sets = {name: common.byte_set(bytes(chars)) for name, chars in _CLASSES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: np.zeros(batch.num_rows) for name in STATISTICS}
            data, offsets = common.text_buffers(batch.column(1))
            for first, last in common.chunks(offsets):
                _chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], sets, {k: v[first:last] for k, v in out.items()})
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(out[name]) for name in STATISTICS]], names=["doc_id", *STATISTICS])

    return common.small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS))


def _chunk(data: np.ndarray, offsets: np.ndarray, sets: dict[str, np.ndarray], out: dict[str, np.ndarray]) -> None:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    some = np.maximum(sizes, 1)
    out["log_bytes"][:] = np.log1p(sizes)
    for name, chars in sets.items():
        total = np.concatenate([[0], np.cumsum(chars[data])])
        out[name][:] = (total[offsets[1:]] - total[offsets[:-1]]) / some
    starts, ends, rows, hashes = common.words(common.LOWER[data], offsets, common.SPACES)
    at = common.by_row(rows, n)
    counts = np.diff(at)
    count = np.maximum(counts, 1)
    out["log_words"][:] = np.log1p(counts)
    if not len(rows):
        return
    long = ends - starts
    for name, values in (("word_bytes", long), ("short_words", long <= 3), ("capitals", sets["upper"][data[starts]])):
        out[name][:] = np.bincount(rows, weights=values, minlength=n) / count
    has = np.flatnonzero(counts)
    out["longest_word"][has] = np.log1p(np.maximum.reduceat(long, at[has]))
    same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out["repeats"][:] = np.bincount(rows[1:], weights=same, minlength=n) / count
    for i in has:
        often = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)[1]
        out["distinct"][i], out["top_word"][i] = len(often) / counts[i], often.max() / counts[i]


Condition = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass(frozen=True)
class Rules:
    """The ensemble: a bias, and conjunctions of conditions with their weights."""

    bias: float
    weights: tuple[float, ...] = ()
    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def score(self) -> Column:
        """The score as a column of the statistics."""
        total = F.lit(self.bias)
        for weight, rule in zip(self.weights, self.rules, strict=True):
            held = F.lit(True)
            for i, above, cut in rule:
                held = held & ((F.col(STATISTICS[i]) > cut) if above else (F.col(STATISTICS[i]) <= cut))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(values: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, paths: list, out: np.ndarray) -> None:
    """A tree by second-order gain; appends the paths to its nodes and adds its leaves' values to out."""
    if path:
        paths.append(path)
    best = (1e-6, -1, 0.0)
    total, weight = slope[rows].sum(), curve[rows].sum()
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        base = total * total / (weight + 1)
        for i, own in enumerate(cuts):
            if not len(own):
                continue
            place = np.searchsorted(own, values[rows, i], side="left")
            g = np.cumsum(np.bincount(place, weights=slope[rows], minlength=len(own) + 1))[:-1]
            h = np.cumsum(np.bincount(place, weights=curve[rows], minlength=len(own) + 1))[:-1]
            n = np.cumsum(np.bincount(place, minlength=len(own) + 1))[:-1]
            gain = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - base
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), i, float(own[j]))
    if best[1] < 0:
        out[rows] += SHRINK * total / (weight + 1)
        return
    _, i, cut = best
    above = values[rows, i] > cut
    for side in (False, True):
        _grow(values, slope, curve, cuts, rows[above == side], (*path, (i, side, cut)), paths, out)


def fit(values: np.ndarray, labels: np.ndarray) -> Rules:
    """values: rows of STATISTICS; labels: 0 or 1."""
    if not len(labels):
        return Rules(0.0)
    if labels.min() == labels.max():
        return Rules(36.0 if labels[0] else -36.0)
    cuts = [np.unique(np.quantile(values[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(values.shape[1])]
    margin = np.full(len(labels), np.log(labels.mean() / (1 - labels.mean())))
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths: list[tuple] = []
        _grow(values, labels - p, p * (1 - p), cuts, np.arange(len(labels)), (), paths, margin)
        found.update(dict.fromkeys(tuple(sorted(path)) for path in paths))
    rules = list(found)
    held = np.ones((len(labels), len(rules)), dtype=np.float64)
    for j, rule in enumerate(rules):
        for i, above, cut in rule:
            held[:, j] *= (values[:, i] > cut) if above else (values[:, i] <= cut)
    weights, bias = _lasso(held, labels.astype(np.float64))
    kept = [j for j in range(len(rules)) if weights[j]]
    return Rules(float(bias), tuple(float(weights[j]) for j in kept), tuple(rules[j] for j in kept))


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the bias is free."""
    n, k = x.shape
    full = np.hstack([x, np.ones((n, 1))])
    probe = np.ones(k + 1)
    for _ in range(30):
        probe = full.T @ (full @ probe)
        probe /= np.linalg.norm(probe)
    rate = 4 * n / float(np.linalg.norm(full.T @ (full @ probe)))
    w = np.zeros(k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        slope = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    return w[:-1], w[-1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame) -> Rules:
    """Fits the ensemble on the bounded sample of stats with labels (doc_id, quality)."""
    asked = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("quality").isNotNull()).select("doc_id", "quality")
    n = asked.count()
    if n > MOST_ROWS:
        asked = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MOST_ROWS / n))
    rows = stats.join(asked, "doc_id").select("doc_id", *STATISTICS, F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(dtype=np.float64), rows["quality"].to_numpy(dtype=np.int64))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents."""
    stats, _ = saved(statistics(table(spark, sf_dir, "documents")), "statistics")
    score = train(stats, table(spark, sf_dir, "labels")).score()
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

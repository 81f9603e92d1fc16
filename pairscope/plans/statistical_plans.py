"""Queries of statistics, samples, bootstrap intervals and selection policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.operators import sampling as O
from pairscope.operators import select as M
from pairscope.operators import stats as T
from pairscope.operators import summarize as S
from pairscope.plans import relational_plans as R
from pairscope.plans.base import long, query, r6
from pairscope.sources import bindings as B


def _rounded(df, *columns):
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


DESCRIBE = "count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std_pop, round(min(v), 6) AS low, round(max(v), 6) AS high"


@query("A5_describe", B.with_sql("scores", f", {R.DELTAS} SELECT conflict_type, {DESCRIBE.replace('(v)', '(difference)')} FROM d GROUP BY conflict_type"))
def a5(spark, sf):
    found = T.describe(F.col("difference"))
    return R._deltas(spark, sf).groupBy("conflict_type").agg(*[c.alias(n) if n == "n" else r6(c).alias(n) for n, c in found.items()])


@query("A6_distribution", B.with_sql("labeled", "SELECT stratum, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std_samp, round(median(score), 6) AS median, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.75), 6) AS q75, round(min(score), 6) AS low, round(max(score), 6) AS high FROM labeled GROUP BY stratum"))
def a6(spark, sf):
    rows = B.labeled(spark, sf)
    plain = rows.groupBy("stratum").agg(*[r6(c.cast("double")).alias(n) for n, c in (("mean", F.avg("score")), ("std_samp", F.stddev_samp("score")), ("low", F.min("score")), ("high", F.max("score")))])
    ranked = T.quantiles(rows, "score", ["stratum"], {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return plain.join(_rounded(ranked, "median", "q25", "q75"), "stratum")


@query("A21_policy_references", B.with_sql("labeled", "SELECT round(avg(before), 6) AS always_native, round(avg(after), 6) AS always_intervene, round(avg(greatest(before, after)), 6) AS oracle FROM labeled"))
def a21(spark, sf):
    return B.labeled(spark, sf).agg(r6(F.avg("before")).alias("always_native"), r6(F.avg("after")).alias("always_intervene"), r6(F.avg(F.greatest("before", "after"))).alias("oracle"))


def _policy_sql(empty: str) -> str:
    return B.with_sql("labeled", f"""SELECT stratum, count(*) AS n, count(*) FILTER (s) AS selected, round(count(*) FILTER (s) / count(*), 6) AS selection_rate, round(avg(CASE WHEN s THEN after ELSE before END), 6) AS utility, round(avg(before), 6) AS utility_before, round(avg(after), 6) AS utility_after, round(avg(greatest(before, after)), 6) AS oracle,
 round(count(*) FILTER (s AND after > before) / nullif(count(*) FILTER (after > before), 0), 6) AS capture, {empty} AS harm_avoidance FROM (SELECT *, probability >= 0.5 AS s FROM labeled) GROUP BY stratum""")


HARM = "round(count(*) FILTER (after < before AND NOT s) / nullif(count(*) FILTER (after < before), 0), 6)"


def _policy(spark, sf, no_harm):
    found = S.policy(F.col("probability") >= 0.5, F.col("before"), F.col("after"), no_harm)
    return B.labeled(spark, sf).groupBy("stratum").agg(*[c.alias(n) if n in ("n", "selected") else r6(c).alias(n) for n, c in found.items()])


@query("A22_policy_metrics", _policy_sql(f"coalesce({HARM}, 1)"))
def a22(spark, sf):
    return _policy(spark, sf, 1.0)


@query("A22_policy_metrics_null", _policy_sql(HARM))
def a22_null(spark, sf):
    return _policy(spark, sf, None)


@query("A24_means_by_transition", B.with_sql("labeled", "SELECT effect, round(avg(score), 6) AS score, round(avg(probability), 6) AS probability FROM labeled GROUP BY effect"))
def a24(spark, sf):
    return B.labeled(spark, sf).groupBy("effect").agg(r6(F.avg("score")).alias("score"), r6(F.avg("probability")).alias("probability"))


LONG_DELTAS = f"{R.DELTAS}, u AS (SELECT image_id, conflict_type, 'conflict_delta' AS feature, conflict_delta AS v FROM d UNION ALL SELECT image_id, conflict_type, 'clean_delta', clean_delta FROM d UNION ALL SELECT image_id, conflict_type, 'difference', difference FROM d)"


@query("A25_reliability_summary", B.with_sql("scores", f", {LONG_DELTAS} SELECT CASE WHEN grouping(conflict_type) = 1 THEN '(all)' ELSE conflict_type END AS conflict_type, feature, {DESCRIBE}, count(*) FILTER (v > 0) AS positive FROM u GROUP BY GROUPING SETS ((feature), (feature, conflict_type))"))
def a25(spark, sf):
    rows = T.unpivoted(R._deltas(spark, sf), ["image_id", "conflict_type"], ["conflict_delta", "clean_delta", "difference"])
    found = {n: c if n == "n" else r6(c) for n, c in T.describe(F.col("value")).items()} | {"positive": F.count_if(F.col("value") > 0)}
    return S.grouped(rows, [["feature"], ["feature", "conflict_type"]], found)


@query("A29_score_by_transition", B.with_sql("labeled", "SELECT effect, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM labeled GROUP BY effect"))
def a29(spark, sf):
    return B.labeled(spark, sf).groupBy("effect").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean"), r6(F.median("score")).alias("median"))


@query("A26_review_summary", f"SELECT count(*) AS n, count(*) FILTER (c <> '') AS confirmed, CASE WHEN count(*) FILTER (c <> '') = count(*) THEN 'complete' ELSE 'incomplete' END AS status, round(count(*) FILTER (a = 'yes') / nullif(count(*) FILTER (a IN ('yes', 'no')), 0), 6) AS ai_rate, round(count(*) FILTER (r = 'yes') / nullif(count(*) FILTER (r IN ('yes', 'no')), 0), 6) AS human_rate FROM (SELECT *, CASE c WHEN 'accept' THEN a WHEN 'edit' THEN b END AS r FROM (SELECT {R.LABELS}, CASE doc_id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'edit' ELSE '' END AS c FROM documents))")
def a26(spark, sf):
    from pairscope.operators import review as V

    confirmation = F.when(F.col("doc_id") % 6 == 0, "accept").when(F.col("doc_id") % 6 == 1, "edit").otherwise("")
    rows = R._labels(spark, sf).withColumn("c", confirmation).withColumn("r", V.resolved(F.col("a"), F.col("b"), F.col("c")))

    def share(c):
        return r6(S.rate(F.count_if(F.col(c) == "yes"), F.count_if(F.col(c).isin("yes", "no"))))

    done = F.count_if(F.col("c") != "")
    return rows.agg(F.count(F.lit(1)).alias("n"), done.alias("confirmed"), F.when(done == F.count(F.lit(1)), "complete").otherwise("incomplete").alias("status"), share("a").alias("ai_rate"), share("r").alias("human_rate"))


@query("A28_type_histogram", B.with_sql("qa", "SELECT conflict_type, count(*) AS n FROM qa GROUP BY conflict_type"))
def a28(spark, sf):
    return S.histogram(B.qa(spark, sf), "conflict_type")


@query("A30_mean_of_field", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def a30(spark, sf):
    return B.table(spark, sf, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"))


def _auroc_sql(score: str, label: str, by: str, source: str, places: int = 6) -> str:
    return f"""SELECT {by}, np AS n_positive, nn AS n_negative, round((s - np * (np + 1) / 2) / nullif(np * nn, 0), {places}) AS auroc FROM (
 SELECT {by}, count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn, sum(r) FILTER (y) AS s FROM (
 SELECT {by}, {label} AS y, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2 AS r FROM {source}) GROUP BY {by})"""


@query("T1_auroc", B.with_sql("labeled", _auroc_sql("score", "target", "stratum", "labeled")))
def t1(spark, sf):
    return _rounded(T.auroc(B.labeled(spark, sf), "score", "target", ["stratum"]), "auroc")


@query("T2_auroc_overall", B.with_sql("labeled", f"SELECT n_positive, n_negative, auroc FROM ({_auroc_sql('probability', 'target', 'one', '(SELECT *, 1 AS one FROM labeled)')})"))
def t2(spark, sf):
    return _rounded(T.auroc(B.labeled(spark, sf), "probability", "target", []), "auroc")


@query("T3_average_precision", B.with_sql("labeled", "SELECT stratum, round(sum(p * h / m) / sum(p), 6) AS average_precision FROM (SELECT stratum, p, sum(p) OVER w AS h, sum(c) OVER w AS m FROM (SELECT stratum, score, count(*) FILTER (target) AS p, count(*) AS c FROM labeled GROUP BY ALL) WINDOW w AS (PARTITION BY stratum ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY stratum"))
def t3(spark, sf):
    return _rounded(T.average_precision(B.labeled(spark, sf), "score", "target", ["stratum"]), "average_precision")


BINOMIAL = "round(CASE WHEN f + g = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(f, g) + 1), lambda i: exp(lgamma(f + g + 1) - lgamma(i + 1) - lgamma(f + g - i + 1) + (f + g) * ln(0.5))))) END, 6)"


@query("T4_exact_mcnemar", f"SELECT source, f AS first_only, g AS second_only, {BINOMIAL} AS p_value FROM (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS f, count(*) FILTER (quality = 0 AND toxic = 1) AS g FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def t4(spark, sf):
    rows = B.labeled(spark, sf).groupBy("source").agg(F.count_if((F.col("after") == 1) & (F.col("before") == 0)).alias("first_only"), F.count_if((F.col("after") == 0) & (F.col("before") == 1)).alias("second_only"))
    return rows.select("source", "first_only", "second_only", r6(T.exact_two_sided(F.col("first_only"), F.col("second_only"))).alias("p_value"))


@query("T5_sign_test", B.with_sql("scores", f", {R.DELTAS} SELECT conflict_type, {BINOMIAL} AS p_value FROM (SELECT conflict_type, count(*) FILTER (difference > 0) AS f, count(*) FILTER (difference < 0) AS g FROM d GROUP BY conflict_type)"))
def t5(spark, sf):
    rows = R._deltas(spark, sf).groupBy("conflict_type").agg(F.count_if(F.col("difference") > 0).alias("f"), F.count_if(F.col("difference") < 0).alias("g"))
    return rows.select("conflict_type", r6(T.exact_two_sided(F.col("f"), F.col("g"))).alias("p_value"))


@query("T6_pearson", B.with_sql("scores", f", {R.DELTAS} SELECT conflict_type, round(covar_pop(conflict_delta, clean_delta) / nullif(stddev_pop(conflict_delta) * stddev_pop(clean_delta), 0), 6) AS r FROM d GROUP BY conflict_type"))
def t6(spark, sf):
    return R._deltas(spark, sf).groupBy("conflict_type").agg(r6(T.pearson(F.col("conflict_delta"), F.col("clean_delta"))).alias("r"))


@query("T7_quantile", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def t7(spark, sf):
    return _rounded(T.quantiles(B.table(spark, sf, "events"), "value", ["event_type"], {"q10": 0.1, "q90": 0.9}), "q10", "q90")


REPLICATES = 20


def _draws_sql(source: str, order: str, by: str, seed: int) -> str:
    """b: bootstrap samples of source within the groups of by, as stats.resampled draws them."""
    part, key = (f"PARTITION BY {by}", f"{by} || ':'") if by else ("", "':'")
    own = f"{by}, " if by else ""
    head = f"'{seed}|' || {by}::VARCHAR" if by else f"'{seed}'"
    joined = f"n.i = d.i AND n.{by} = d.{by}" if by else "n.i = d.i"
    return f"""n AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS i, count(*) OVER ({part}) AS m FROM {source}),
z AS (SELECT DISTINCT {own}m FROM n), d AS (SELECT {own}replicate, ('0x' || substr(md5({head} || ':' || replicate || ':' || place), 1, 8))::BIGINT % m AS i FROM z, (SELECT unnest(range(0, {REPLICATES})) AS replicate), LATERAL (SELECT unnest(range(0, m)) AS place)),
b AS (SELECT n.*, d.replicate FROM d JOIN n ON {joined})"""


@query("T8_stratified_bootstrap", B.with_sql("labeled", f""", {_draws_sql('labeled', 'id', 'target', 11)}, a AS (SELECT auroc FROM ({_auroc_sql('score', 'target', 'replicate', 'b')}))
SELECT count(auroc) AS valid_resamples, round(quantile_cont(auroc, 0.025), 6) AS ci_low, round(quantile_cont(auroc, 0.975), 6) AS ci_high FROM a""").replace("|' || target::VARCHAR", "|' || target::VARCHAR"))
def t8(spark, sf):
    drawn = T.resampled(B.labeled(spark, sf).select("id", "score", "target"), ["id"], 11, REPLICATES, ["target"])
    areas = _rounded(T.auroc(drawn, "score", "target", ["replicate"]), "auroc")
    return _rounded(T.interval(areas, "auroc", []), "ci_low", "ci_high")


def _ap_sql(score: str, label: str, by: str, source: str) -> str:
    return f"""SELECT {by}, sum(p * h / m) / sum(p) AS average_precision FROM (SELECT {by}, p, sum(p) OVER w AS h, sum(c) OVER w AS m FROM (SELECT {by}, {score}, count(*) FILTER ({label}) AS p, count(*) AS c FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {by}"""


CI = "count(value) AS valid_resamples, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high"

#: Few rows, so that some replicates have one class and are skipped.
SMALL = "small AS (SELECT id, score, target, probability FROM labeled WHERE id % 97 = 1 OR (id % 7 = 0 AND NOT target))"


def _small(spark, sf):
    return B.labeled(spark, sf).where("id % 97 = 1 OR (id % 7 = 0 AND NOT target)").select("id", F.col("score").cast("double").alias("score"), "target", "probability")


@query("T9_sample_bootstrap", B.with_sql("labeled", f""", {SMALL}, {_draws_sql('small', 'id', '', 12)}, o AS (SELECT replicate FROM b GROUP BY replicate HAVING bool_and(target) OR bool_and(NOT target)), x AS (SELECT * FROM b WHERE replicate NOT IN (SELECT replicate FROM o)),
v AS (SELECT 'mean' AS metric, avg(score) AS value FROM b GROUP BY replicate UNION ALL SELECT 'auroc', auroc FROM ({_auroc_sql('score', 'target', 'replicate', 'x', 12)}) UNION ALL SELECT 'average_precision', average_precision FROM ({_ap_sql('score', 'target', 'replicate', 'x')}))
SELECT metric, {CI} FROM v GROUP BY metric"""))
def t9(spark, sf):
    drawn = T.resampled(_small(spark, sf), ["id"], 12, REPLICATES, [])
    return _rounded(T.metric_intervals(drawn, "score", "target", []), "ci_low", "ci_high")


@query("T10_paired_bootstrap", B.with_sql("labeled", f""", {_draws_sql('labeled', 'id', '', 13)}, g AS (SELECT replicate, avg(score / 997 - probability) AS value FROM b GROUP BY replicate),
u AS (SELECT a.auroc - p.auroc AS value FROM ({_auroc_sql('score', 'target', 'replicate', 'b', 12)}) a JOIN ({_auroc_sql('probability', 'target', 'replicate', 'b', 12)}) p USING (replicate))
SELECT 'mean' AS metric, {CI} FROM g UNION ALL SELECT 'auroc', {CI} FROM u"""))
def t10(spark, sf):
    rows = B.labeled(spark, sf).select("id", "target", (F.col("score") / 997).alias("score"), "probability")
    return _rounded(T.paired_intervals(T.resampled(rows, ["id"], 13, REPLICATES, []), "score", "probability", "target", []), "ci_low", "ci_high")


@query("T11_group_bootstrap", B.with_sql("labeled", f", g AS (SELECT DISTINCT image_hash FROM labeled), {_draws_sql('g', 'image_hash', '', 14)}, a AS (SELECT replicate, avg(score) AS mean FROM b JOIN labeled USING (image_hash) GROUP BY replicate) SELECT count(mean) AS valid_resamples, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM a"))
def t11(spark, sf):
    drawn = T.group_draws(B.labeled(spark, sf).select("image_hash", "score"), "image_hash", 14, REPLICATES)
    return _rounded(T.interval(drawn.groupBy("replicate").agg(F.avg("score").alias("mean")), "mean", []), "ci_low", "ci_high")


FEATURES = "f AS (SELECT id, target, before = 1 AS toxic, 'negative_score' AS feature, -score::DOUBLE AS v FROM labeled UNION ALL SELECT id, target, before = 1, 'probability', probability FROM labeled)"


def _features(spark, sf):
    rows = B.labeled(spark, sf).select("id", "target", (F.col("before") == 1).alias("toxic"), (-F.col("score").cast("double")).alias("negative_score"), "probability")
    return T.unpivoted(rows, ["id", "target", "toxic"], ["negative_score", "probability"])


@query("T12_feature_label_grid", B.with_sql("labeled", f", {FEATURES}, x AS (SELECT feature || '/' || label AS cell, y, v FROM (SELECT feature, v, 'target' AS label, target AS y FROM f UNION ALL SELECT feature, v, 'toxic', toxic FROM f)) {_auroc_sql('v', 'y', 'cell', 'x')}"))
def t12(spark, sf):
    rows = _features(spark, sf)
    cells = rows.select("value", F.inline(F.array(*[F.struct(F.concat(F.col("feature"), F.lit(f"/{n}")).alias("cell"), F.col(n).alias("y")) for n in ("target", "toxic")])))
    return _rounded(T.auroc(cells, "value", "y", ["cell"]), "auroc")


@query("T13_univariate", B.with_sql("labeled", f""", {FEATURES}, k AS (SELECT *, feature || '|' || target::VARCHAR AS cell FROM f), {_draws_sql('k', 'id', 'cell', 15)},
i AS (SELECT feature, {CI} FROM (SELECT split_part(c, '/', 1) AS feature, auroc AS value FROM ({_auroc_sql('v', 'target', 'c', "(SELECT *, feature || '/' || replicate AS c FROM b)", 12)})) GROUP BY feature),
s AS (SELECT feature, {DESCRIBE}, round(avg(v) FILTER (target), 6) AS mean_positive, round(avg(v) FILTER (NOT target), 6) AS mean_negative FROM f GROUP BY feature)
SELECT * FROM ({_auroc_sql('v', 'target', 'feature', 'f')}) JOIN s USING (feature) JOIN i USING (feature)"""))
def t13(spark, sf):
    rows = _features(spark, sf)
    found = {n: c if n == "n" else r6(c) for n, c in T.describe(F.col("value")).items() if n != "median"}
    found |= {"mean_positive": r6(F.avg(F.when(F.col("target"), F.col("value")))), "mean_negative": r6(F.avg(F.when(~F.col("target"), F.col("value"))))}
    means = rows.groupBy("feature").agg(*[c.alias(n) for n, c in found.items()]).join(_rounded(T.quantiles(rows, "value", ["feature"], {"median": 0.5}), "median"), "feature")
    drawn = T.resampled(rows, ["id"], 15, REPLICATES, ["feature", "target"])
    limits = T.interval(T.auroc(drawn, "value", "target", ["feature", "replicate"]), "auroc", ["feature"])
    return _rounded(T.auroc(rows, "value", "target", ["feature"]), "auroc").join(means, "feature").join(_rounded(limits, "ci_low", "ci_high"), "feature")


@query("T14_score_agreement", B.with_sql("scores", f", {R.DELTAS} SELECT round(avg(abs(conflict_delta - clean_delta)), 6) AS mean_abs, round(max(abs(conflict_delta - clean_delta)), 6) AS max_abs, round(corr(conflict_delta, clean_delta), 6) AS r FROM d"))
def t14(spark, sf):
    apart = F.abs(F.col("conflict_delta") - F.col("clean_delta"))
    return R._deltas(spark, sf).agg(r6(F.avg(apart)).alias("mean_abs"), r6(F.max(apart)).alias("max_abs"), r6(T.pearson(F.col("conflict_delta"), F.col("clean_delta"))).alias("r"))


@query("T15_scores_and_generation", B.with_sql("labeled", f"SELECT g.effect, g.n, g.mean, a.auroc FROM (SELECT effect, count(*) AS n, round(avg(score), 6) AS mean FROM labeled GROUP BY effect) g, ({_auroc_sql('score', 'target', 'one', '(SELECT *, 1 AS one FROM labeled)')}) a"))
def t15(spark, sf):
    rows = B.labeled(spark, sf)
    area = _rounded(T.auroc(rows.withColumn("one", F.lit(1)), "score", "target", ["one"]), "auroc").select("one", "auroc")
    return rows.groupBy("effect").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean")).withColumn("one", F.lit(1)).join(area, "one").drop("one")


@query("T16_label_alignment", B.with_sql("labeled", f", l AS (SELECT 'target' AS label, target AS y, probability AS v FROM labeled UNION ALL SELECT 'toxic', before = 1, probability FROM labeled) SELECT a.label, n_positive, n_negative, auroc, mean_positive, mean_negative FROM ({_auroc_sql('v', 'y', 'label', 'l')}) a JOIN (SELECT label, round(avg(v) FILTER (y), 6) AS mean_positive, round(avg(v) FILTER (NOT y), 6) AS mean_negative FROM l GROUP BY label) m USING (label)"))
def t16(spark, sf):
    rows = B.labeled(spark, sf).select("probability", F.inline(F.array(F.struct(F.lit("target").alias("label"), F.col("target").alias("y")), F.struct(F.lit("toxic").alias("label"), (F.col("before") == 1).alias("y")))))
    return _rounded(T.alignment(rows, "probability", "y", ["label"]), "auroc", "mean_positive", "mean_negative")


QUOTA = "q AS (SELECT lang, n, fl + (row_number() OVER (ORDER BY raw - fl DESC, n DESC, lang DESC) <= {size} - sum(fl) OVER ())::INT AS quota FROM (SELECT *, floor(raw) AS fl FROM (SELECT lang, count(*) AS n, {size} * count(*) / sum(count(*)) OVER () AS raw FROM documents GROUP BY lang)))"


@query("O1_quotas", f"WITH {QUOTA.format(size=97)} SELECT lang, n AS n_rows, quota::BIGINT AS quota FROM q")
def o1(spark, sf):
    return O.quotas(B.table(spark, sf, "documents"), "lang", 97).select("lang", "n_rows", long("quota").alias("quota"))


RANKED = "row_number() OVER (PARTITION BY lang ORDER BY sha256('{seed}:' || doc_id), doc_id)"


@query("O2_stratified_sample", f"WITH {QUOTA.format(size=97)} SELECT doc_id, lang, sha256('5:' || doc_id) AS sample_order FROM (SELECT *, {RANKED.format(seed=5)} AS r FROM documents) JOIN q USING (lang) WHERE r <= quota")
def o2(spark, sf):
    return O.stratified(B.table(spark, sf, "documents"), "doc_id", "lang", 97, 5).select("doc_id", "lang", "sample_order")


@query("O3_nested_samples", f"""WITH {QUOTA.format(size=97)}, s1 AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, {RANKED.format(seed=5)} AS r FROM documents) JOIN q USING (lang) WHERE r <= quota),
q2 AS (SELECT lang, fl + (row_number() OVER (ORDER BY raw - fl DESC, n DESC, lang DESC) <= 31 - sum(fl) OVER ())::INT AS quota FROM (SELECT *, floor(raw) AS fl FROM (SELECT lang, count(*) AS n, 31 * count(*) / sum(count(*)) OVER () AS raw FROM s1 GROUP BY lang))),
s2 AS (SELECT doc_id FROM (SELECT doc_id, lang, {RANKED.format(seed=6)} AS r FROM s1) JOIN q2 USING (lang) WHERE r <= quota)
SELECT doc_id, doc_id IN (SELECT doc_id FROM s1) AS in_baseline, doc_id IN (SELECT doc_id FROM s2) AS in_audit FROM documents""")
def o3(spark, sf):
    return O.nested(B.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", {"in_baseline": 97, "in_audit": 31}, 5).select("doc_id", "in_baseline", "in_audit")


@query("O4_hash_order", "SELECT item_id, sha256('42:' || item_id) AS rank_key FROM benchmark")
def o4(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", O.shuffled_key(42, F.col("item_id")).alias("rank_key"))


WANTED = {"BUILDING": 3, "MACHINERY": 3, "FURNITURE": 3}


@query("O5_pruned_candidates", B.with_sql("answers", "SELECT question_id, place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, question_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stratum, image_id ORDER BY k, question_id) AS f FROM (SELECT *, sha256('9:' || question_id) AS k FROM answers WHERE stratum IN ('BUILDING', 'MACHINERY', 'FURNITURE'))) WHERE f = 1) WHERE place <= 9"))
def o5(spark, sf):
    return O.pruned_candidates(B.answers(spark, sf), "question_id", "stratum", "image_id", WANTED, 9).select("question_id", "place")


@query("O5_balanced_sample")
def o5_sample(spark, sf):
    return O.balanced(B.answers(spark, sf), "question_id", "stratum", "image_id", WANTED, 9).select("question_id", "stratum", "image_id", "sample_order")


@query("O7_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o7(spark, sf):
    return O.top(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query("O8_evenly_spaced", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)) WHERE i = 0 OR floor(i * 20 / n) > floor((i - 1) * 20 / n)")
def o8(spark, sf):
    return O.evenly_spaced(B.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", ["lang"], 20)


@query("M1_prepared_rows", B.with_sql("labeled", "SELECT id, score::DOUBLE AS f0, round(probability, 6) AS f1, target, after - before AS utility_gain FROM labeled"))
def m1(spark, sf):
    rows = M.prepare(B.labeled(spark, sf), ["score", "probability"], "target", "before", "after")
    return rows.select("id", F.get("features", 0).alias("f0"), r6(F.get("features", 1)).alias("f1"), "target", "utility_gain")


@query("M2_policy_utility", B.with_sql("labeled", "SELECT id, CASE WHEN probability > 0.4 THEN after ELSE before END AS utility FROM labeled"))
def m2(spark, sf):
    return B.labeled(spark, sf).select("id", M.policy_utility(F.col("probability") > 0.4, F.col("before"), F.col("after")).alias("utility"))


@query("M3_threshold", B.with_sql("labeled", """, c AS (SELECT DISTINCT stratum, probability AS t FROM labeled UNION SELECT DISTINCT stratum, 0.0 FROM labeled UNION SELECT DISTINCT stratum, 1.0000000000000002 FROM labeled),
e AS (SELECT c.stratum, t, round(avg(CASE WHEN probability >= t THEN after ELSE before END), 12) AS u, avg((probability >= t)::INT) AS s FROM c JOIN labeled USING (stratum) GROUP BY ALL)
SELECT stratum, round(t, 6) AS threshold, round(u, 6) AS utility, round(s, 6) AS selection_rate FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u DESC, s, t DESC) AS k FROM e) WHERE k = 1"""))
def m3(spark, sf):
    return _rounded(T.threshold_choice(B.labeled(spark, sf), "probability", "before", "after", ["stratum"]), "threshold", "utility", "selection_rate")


@query("M5_standardized", B.with_sql("labeled", "SELECT id, round((score - m) / s, 6) AS score FROM labeled, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM labeled WHERE before = 0)"))
def m5(spark, sf):
    return M.standardized(B.labeled(spark, sf).select("id", "score", "before"), ["score"], F.col("before") == 0).select("id", r6("score").alias("score"))


STUDY = M.Study({"score": ("score",), "both": ("score", "probability")}, group="image_hash", folds=3, repeats=2, penalties=(0.1, 1.0))


def _study_rows(spark, sf):
    return B.labeled(spark, sf)


@query("M10_nested_cv")
def m10(spark, sf):
    return M.nested_cv(_study_rows(spark, sf), STUDY)


@query("M12_transfer")
def m12(spark, sf):
    rows = _study_rows(spark, sf)
    return M.transfer(rows.where("stratum = 'en'"), rows.where("stratum <> 'en'"), STUDY, "both").select("id", "probability", "selected")


@query("M13_go_no_go", B.with_sql("labeled", "SELECT stratum, CASE WHEN avg(after - before) >= 0.5 AND avg(probability) >= 0.4 AND avg(target::INT) >= 0.8 THEN 'conditional_go' ELSE 'no_go' END AS decision FROM labeled GROUP BY stratum"))
def m13(spark, sf):
    decision = M.go_no_go(F.avg(F.col("after") - F.col("before")), F.avg("probability"), F.avg(F.col("target").cast("double")), 0.5, 0.4, 0.8)
    return B.labeled(spark, sf).groupBy("stratum").agg(decision.alias("decision"))


#: Decisions that stand for out-of-fold ones: three feature sets, two repeats, by rules that SQL can say.
DECISIONS = """dc AS (SELECT feature_set, repeat, id, target, before, after, p, p >= 0.5 AS selected FROM (SELECT id, target, before, after, unnest(['a', 'b', 'c']) AS feature_set, unnest([probability, score / 997, (id % 89) / 89.0::DOUBLE]) AS q FROM labeled), (SELECT unnest([0, 1]) AS repeat), LATERAL (SELECT CASE repeat WHEN 0 THEN q ELSE 1 - (1 - q) * 0.9 END AS p))"""


def _decisions(spark, sf):
    rows = B.labeled(spark, sf)
    sets = F.array(*[F.struct(F.lit(n).alias("feature_set"), q.alias("q")) for n, q in (("a", F.col("probability")), ("b", F.col("score") / 997), ("c", (F.col("id") % 89) / 89))])
    each = rows.select("id", F.inline(sets)).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    p = F.when(F.col("repeat") == 0, F.col("q")).otherwise(1 - (1 - F.col("q")) * 0.9)
    return each.select("feature_set", "repeat", "id", p.alias("probability"), (p >= 0.5).alias("selected")), rows


@query("M14_compare_feature_sets", B.with_sql("labeled", f""", {DECISIONS}, e AS (SELECT feature_set, id, target, avg(p) AS p, avg(CASE WHEN selected THEN after ELSE before END) AS u FROM dc GROUP BY ALL),
r AS (SELECT a.feature_set || '|' || b.feature_set AS pair, a.id, a.target, a.p AS p1, b.p AS p2, a.u AS u1, b.u AS u2 FROM e a JOIN e b ON a.id = b.id AND a.feature_set < b.feature_set), {_draws_sql('r', 'id', 'pair', 16)},
k AS (SELECT *, pair || '/' || replicate AS c FROM b),
v AS (SELECT pair, 'mean' AS metric, avg(u2 - u1) AS value FROM b GROUP BY pair, replicate UNION ALL SELECT split_part(x.c, '/', 1), 'auroc', y.auroc - x.auroc FROM ({_auroc_sql('p1', 'target', 'c', 'k', 12)}) x JOIN ({_auroc_sql('p2', 'target', 'c', 'k', 12)}) y USING (c)),
g AS (SELECT pair, 'mean' AS metric, avg(u2 - u1) AS gain FROM r GROUP BY pair UNION ALL SELECT x.pair, 'auroc', y.auroc - x.auroc FROM ({_auroc_sql('p1', 'target', 'pair', 'r', 12)}) x JOIN ({_auroc_sql('p2', 'target', 'pair', 'r', 12)}) y USING (pair))
SELECT split_part(pair, '|', 1) AS first, split_part(pair, '|', 2) AS second, metric, round(any_value(gain), 6) AS gain, {CI} FROM v JOIN g USING (pair, metric) GROUP BY pair, metric"""))
def m14(spark, sf):
    decisions, rows = _decisions(spark, sf)
    found = M.compare_sets(decisions, rows, "id", "target", "before", "after", 16, REPLICATES)
    return _rounded(found, "gain", "ci_low", "ci_high")


@query("M15_majority_action", B.with_sql("labeled", "SELECT image_hash, avg(before) >= 0.5 AS selected FROM labeled GROUP BY image_hash"))
def m15(spark, sf):
    rows = B.labeled(spark, sf).select(F.lit("all").alias("feature_set"), "image_hash", "probability", (F.col("before") == 1).alias("selected"))
    return M.majority(rows, "image_hash").select("image_hash", "selected")


#: A frozen selector of fixed numbers, as one would be read from a file.
FROZEN = M.Frozen(("score", "probability"), (500.0, 0.5), (288.0, 0.29), (0.4, -0.7, 0.1), 0.55)
Z = " + ".join([str(FROZEN.weights[-1]), *[f"({f} - {m}) / {s} * ({w})" for f, m, s, w in zip(FROZEN.features, FROZEN.mean, FROZEN.std, FROZEN.weights, strict=False)]])


@query("M16_frozen_by_stratum", B.with_sql("labeled", f""", ot AS (SELECT *, 1 / (1 + exp(-({Z}))) >= {FROZEN.threshold} AS s FROM labeled WHERE image_hash NOT IN (SELECT image_hash FROM labeled WHERE stratum = 'en') AND stratum <> 'en'), ch AS (SELECT id, stratum, (CASE WHEN s THEN after ELSE before END)::DOUBLE AS u, before::DOUBLE AS w FROM ot), {_draws_sql('ch', 'id', 'stratum', 17)},
v AS (SELECT stratum, avg(u) AS u, avg(u - w) AS d FROM b GROUP BY stratum, replicate), i AS (SELECT stratum, count(u) AS valid_resamples, round(quantile_cont(u, 0.025), 6) AS utility_low, round(quantile_cont(u, 0.975), 6) AS utility_high, round(quantile_cont(d, 0.025), 6) AS gain_low, round(quantile_cont(d, 0.975), 6) AS gain_high FROM v GROUP BY stratum)
SELECT stratum, count(*) AS n, count(*) FILTER (s) AS selected, round(count(*) FILTER (s) / count(*), 6) AS selection_rate, round(avg(CASE WHEN s THEN after ELSE before END), 6) AS utility, round(avg(before), 6) AS utility_before, round(avg(after), 6) AS utility_after, round(avg(greatest(before, after)), 6) AS oracle,
 round(count(*) FILTER (s AND after > before) / nullif(count(*) FILTER (after > before), 0), 6) AS capture, {HARM} AS harm_avoidance, any_value(valid_resamples) AS valid_resamples, any_value(utility_low) AS utility_low, any_value(utility_high) AS utility_high, any_value(gain_low) AS gain_low, any_value(gain_high) AS gain_high
FROM ot JOIN i USING (stratum) GROUP BY stratum"""))
def m16(spark, sf):
    rows = B.labeled(spark, sf)
    other = rows.where("stratum <> 'en'").join(rows.where("stratum = 'en'").select("image_hash").distinct(), "image_hash", "left_anti")
    scored = other.withColumn("selected", FROZEN.probability() >= FROZEN.threshold)
    found = M.by_stratum(scored, "stratum", "id", "before", "after", 17, REPLICATES)
    return _rounded(found, *[c for c in found.columns if c not in ("stratum", "n", "selected", "valid_resamples")])

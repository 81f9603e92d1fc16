"""Queries of sinks, guards, folds and fits that the other modules don't hold."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.operators import contracts as C
from pairscope.operators import sampling as O
from pairscope.operators import select as M
from pairscope.plans import statistical_plans as P
from pairscope.plans import studies
from pairscope.plans.base import query, r6
from pairscope.sources import bindings as B
from pairscope.sources import io


@query("S2_json_sink", "SELECT count(*) AS n_lines FROM conversations")
def s2(spark, sf):
    path = io.scratch(spark, "sink")
    io.write_json_lines(B.table(spark, sf, "conversations"), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


@query("S4_csv_sink", "SELECT 'item_id,kind' AS header, count(*) AS n_rows FROM benchmark")
def s4(spark, sf):
    path = io.scratch(spark, "sink")
    io.write_csv(B.table(spark, sf, "benchmark").withColumn("kind", F.lit("x")), path, ["item_id", "kind"])
    lines = spark.read.text(path)
    heads = F.startswith("value", F.lit("item_id"))
    return lines.agg(F.max(F.when(heads, F.col("value"))).alias("header"), F.count_if(~heads).alias("n_rows"))


@query("S5_csv_with_mark", "SELECT 'efbbbf' AS head, count(*) AS n_rows FROM nation")
def s5(spark, sf):
    with tempfile.NamedTemporaryFile(suffix=".csv") as f:  # a small file of the driver's own
        io.write_small_csv(B.table(spark, sf, "nation"), f.name, ["n_nationkey", "n_name"], bom=True)
        raw = open(f.name, "rb").read()
    return spark.createDataFrame([(raw[:3].hex(), raw.count(b"\n") - 1)], "head string, n_rows long")


@query("S11_summary_sink", "SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents")
def s11(spark, sf):
    with tempfile.NamedTemporaryFile(suffix=".json") as f:
        io.write_summary(B.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs")), f.name)
        found = json.load(open(f.name, encoding="utf-8"))
    return spark.createDataFrame([(found["n"], found["langs"])], "n long, langs long")


@query("S13_missing_files", "SELECT 'n_regionkey=' || (r_regionkey + 2) AS folder FROM region WHERE r_regionkey + 2 NOT IN (SELECT n_regionkey FROM nation)")
def s13(spark, sf):
    path = io.scratch(spark, "files")
    B.table(spark, sf, "nation").write.partitionBy("n_regionkey").parquet(path)
    there = io.listed(spark, path).select(F.regexp_extract("file", r"(n_regionkey=\d+)/[^/]+\.parquet$", 1).alias("folder"))
    wanted = B.table(spark, sf, "region").select(F.concat(F.lit("n_regionkey="), (F.col("r_regionkey") + 2).cast("string")).alias("folder"))
    return wanted.join(there, "folder", "left_anti")


@query("P10_native_prompt", B.with_sql("qa", "SELECT image_id, md5(trim(question)) AS prompt FROM qa"))
def p10(spark, sf):
    return B.qa(spark, sf).select("image_id", F.md5(T.prompt(F.col("question"), F.lit("native_prompt"))).alias("prompt"))


@query("P19_scoring_manifest", "SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY doc_id LIMIT 100")
def p19(spark, sf):
    return O.top(B.table(spark, sf, "documents").where("n_chars > 0").select("doc_id"), [F.col("doc_id")], 100)


@query("V14_overwritten", "SELECT doc_id, 'good' AS mark, 'bad' AS incoming FROM labels WHERE quality = 1 AND toxic = 1")
def v14(spark, sf):
    labels = B.table(spark, sf, "labels")
    held = labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("mark"))
    return C.overwritten(held, labels.where("toxic = 1").select("doc_id", F.lit("bad").alias("mark")), "doc_id", "mark")


@query("J12_skip_missing", "SELECT l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def j12(spark, sf):
    return B.table(spark, sf, "labels").join(B.table(spark, sf, "documents"), "doc_id").select("doc_id", "lang")


@query("O6_sorted_sink", "SELECT doc_id, source FROM documents ORDER BY source, doc_id")
def o6(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "source").orderBy("source", "doc_id")


PAIR = ("score", "probability")


@query("M4_logistic_fit")
def m4(spark, sf):
    return M.fitted(B.labeled(spark, sf), PAIR, "target", "id", "id", 1.0)


@query("M6_stratified_oof")
def m6(spark, sf):
    return M.out_of_fold(B.labeled(spark, sf), PAIR, "target", "id", "id", 3, 1, 1.0).select("id", "probability")


@query("M6_stratified_folds", B.with_sql("labeled", "SELECT count(*) AS n_rows, 3::BIGINT AS n_folds, true AS classes_even FROM labeled"))
def m6_folds(spark, sf):
    rows = B.labeled(spark, sf)
    folds = rows.join(M.fold_groups(rows, "id", "target", 3, [1]), "id").withColumn("fold", F.get("folds", 0))
    per = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("target").alias("p"))
    even = (F.max("p") - F.min("p") <= 1) & (F.max(F.col("n") - F.col("p")) - F.min(F.col("n") - F.col("p")) <= 1)
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"), even.alias("classes_even"))


@query("M7_group_folds", B.with_sql("labeled", """SELECT count(*) AS n_rows, count(DISTINCT image_hash) AS n_groups, 0::BIGINT AS split_groups, 3::BIGINT AS n_folds, count(*) FILTER (target) AS n_positive, true AS both_classes FROM labeled"""))
def m7(spark, sf):
    rows = B.labeled(spark, sf)
    folds = rows.join(M.fold_groups(rows, "image_hash", "target", 3, [1]), "image_hash").withColumn("fold", F.get("folds", 0))
    per = folds.groupBy("image_hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("parts"), F.count_if("target").alias("p"), F.min("fold").alias("fold"))
    held = per.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("parts") > 1).alias("split"))
    rest_p, rest_n = F.sum("p") - F.max("p"), F.sum(F.col("n") - F.col("p")) - F.max(F.col("n") - F.col("p"))  # of the training part with the fewest
    return held.agg(F.sum("n").alias("n_rows"), F.sum("groups").alias("n_groups"), F.sum("split").alias("split_groups"), F.count(F.lit(1)).alias("n_folds"), F.sum("p").alias("n_positive"), ((rest_p > 0) & (rest_n > 0)).alias("both_classes"))


@query("M8_grouped_oof")
def m8(spark, sf):
    return M.out_of_fold(B.labeled(spark, sf), PAIR, "target", "image_hash", "id", 3, 1, 1.0).select("id", "probability")


@query("M9_best_penalty")
def m9(spark, sf):
    return M.chosen_penalty(M.penalty_scores(B.labeled(spark, sf), P.STUDY, "both", 1))


@query("M11_frozen_selector")
def m11(spark, sf):
    frozen = M.freeze(B.labeled(spark, sf), P.STUDY, "both")
    terms = zip((*frozen.features, "intercept"), frozen.weights, strict=True)
    return spark.createDataFrame([(n, float(w), frozen.threshold) for n, w in terms], "term string, weight double, threshold double")


@query("M17_full_run")
def m17(spark, sf):
    found = studies.validate_selectors(B.labeled(spark, sf), P.STUDY, "score", "both", replicates=P.REPLICATES)
    return found["decision"].select(r6("auroc_gain").alias("auroc_gain"), r6("policy_gain").alias("policy_gain"), "wins", "decision")

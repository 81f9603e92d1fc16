"""Queries of scans, projections, contracts, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.functions import vocabulary as V
from pairscope.operators import align as J
from pairscope.operators import contracts as C
from pairscope.operators import review as R
from pairscope.operators import summarize as S
from pairscope.operators.ordering import numbered
from pairscope.plans import text_plans as P
from pairscope.plans.base import long, named, query, r6
from pairscope.sources import bindings as B
from pairscope.sources import io

CONVERSATION = "conv_id long, turn long, role string, text string"


@query("S1_json_lines", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def s1(spark, sf):
    path = io.scratch(spark, "json")
    io.write_json_lines(B.table(spark, sf, "conversations"), path)
    return io.read_json_lines(spark, path, CONVERSATION).select("conv_id", "turn", "role", F.char_length("text").alias("n_chars"))


@query("S3_csv", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, md5(text) AS digest FROM conversations")
def s3(spark, sf):
    path = io.scratch(spark, "csv")
    io.write_csv(B.table(spark, sf, "conversations"), path, ["conv_id", "turn", "role", "text"])
    return io.read_csv(spark, path, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("S6_delimited", B.with_sql("qa", f"SELECT image_id, array_to_string({B.content_sql('ref_words')}, '|') AS delimited FROM qa"))
def s6(spark, sf):
    return io.delimited(B.qa(spark, sf).select("image_id", T.content_tokens(F.col("ref_words")).alias("delimited")))


@query("S7_json_document", "SELECT n_regionkey AS region, n_nationkey AS id, n_name AS name FROM nation")
def s7(spark, sf):
    path = io.scratch(spark, "document")
    rows = B.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("annotations"))
    document = F.to_json(F.struct(F.struct(F.lit("v1").alias("version")).alias("info"), F.col("annotations")), {"pretty": "true"})
    rows.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a document of many lines in each file
    kind = "info struct<version:string>, annotations array<struct<id:bigint,name:string,region:bigint>>"
    return io.read_json_document(spark, path, kind, "annotations").select("region", "id", "name")


@query("S8_row_index", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_idx FROM benchmark")
def s8(spark, sf):
    return numbered(B.table(spark, sf, "benchmark").select("item_id"), [], ["item_id"])


@query("S9_resume", "SELECT conv_id, turn, 2::BIGINT AS runs FROM conversations")
def s9(spark, sf):
    rows, path = B.table(spark, sf, "conversations").select("conv_id", "turn", "role"), io.scratch(spark, "resumed")
    first = io.append_new(rows.where("role = 'assistant'").withColumn("run", F.lit(1)), path, ["conv_id", "turn"])
    second = io.append_new(rows.withColumn("run", F.lit(2)), path, ["conv_id", "turn"])
    again = io.append_new(rows.withColumn("run", F.lit(3)), path, ["conv_id", "turn"])
    done = spark.read.parquet(path)
    return done.select("conv_id", "turn", F.lit((first > 0) + (second > 0) + (again > 0)).cast("long").alias("runs"))


@query("S12_file_digest", "SELECT sha256(string_agg(text || chr(10), '' ORDER BY item_id)) AS sha256, sum(strlen(text) + 1)::BIGINT AS length, false AS pinned FROM benchmark")
def s12(spark, sf):
    path = io.scratch(spark, "digest")
    B.table(spark, sf, "benchmark").coalesce(1).sortWithinPartitions("item_id").select("text").write.text(path)  # one file, as it is one that is hashed
    found = io.file_digests(spark, path).where(F.endswith("file", F.lit(".txt")))
    wrong = io.unpinned(found, {"absent.txt": "00"}).select(F.lit(False).alias("pinned"))
    return found.select("sha256", "length").join(wrong.limit(1), how="left")


@query("S15_count_pins", "SELECT lang, n_rows, expected FROM (SELECT lang, count(*) AS n_rows, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 0 END AS expected FROM documents GROUP BY lang) WHERE n_rows <> expected UNION ALL SELECT 'xx', 0, 5")
def s15(spark, sf):
    return C.wrong_counts(B.table(spark, sf, "documents"), "lang", {"en": 0, "fr": 1, "xx": 5})


@query("P1_flag_sort_limit", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25")
def p1(spark, sf):
    from pairscope.operators.sampling import top

    return top(B.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 25)


@query("P2_select_rename_trim", "SELECT doc_id AS haloquest_id, trim(source) AS origin, lang AS hallucination_type FROM documents WHERE lang IN ('fr', 'de')")
def p2(spark, sf):
    return B.table(spark, sf, "documents").where(F.col("lang").isin("fr", "de")).select(F.col("doc_id").alias("haloquest_id"), F.trim("source").alias("origin"), F.col("lang").alias("hallucination_type"))


@query("P3_label_subset", "SELECT doc_id FROM documents WHERE lang = 'es'")
def p3(spark, sf):
    return B.table(spark, sf, "documents").where("lang = 'es'").select("doc_id")


@query("P4_restrict_to_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def p4(spark, sf):
    return B.table(spark, sf, "documents").join(B.table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("P5_exclude_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p5(spark, sf):
    return B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


def _expanded(rows, column, values):
    return rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(column))


@query("P6_expand_conditions", B.with_sql("qa", "SELECT image_id, condition, CASE condition WHEN 'text_only_conflict' THEN NULL ELSE image_id END AS shown FROM qa, (SELECT unnest(['multimodal_conflict', 'text_only_conflict', 'multimodal_clean']) AS condition)"))
def p6(spark, sf):
    return _expanded(B.qa(spark, sf), "condition", B.CONDITIONS).select("image_id", "condition", F.when(F.col("condition") != "text_only_conflict", F.col("image_id")).alias("shown"))


@query("P7_expand_scores", B.with_sql("qa", "SELECT image_id, condition FROM qa, (SELECT unnest(['conflict_image', 'conflict_text', 'clean_image', 'clean_text']) AS condition)"))
def p7(spark, sf):
    return _expanded(B.qa(spark, sf), "condition", ("conflict_image", "conflict_text", "clean_image", "clean_text")).select("image_id", "condition")


@query("P8_expand_perturbations", B.with_sql("qa", "SELECT image_id, condition, perturbation FROM qa, (SELECT unnest(['conflict', 'clean']) AS condition), (SELECT unnest(['jpeg', 'blur']) AS perturbation)"))
def p8(spark, sf):
    return _expanded(_expanded(B.qa(spark, sf), "condition", ("conflict", "clean")), "perturbation", ("jpeg", "blur")).select("image_id", "condition", "perturbation")


@query("P9_expand_actions", B.with_sql("qa", f"SELECT image_id, action, md5(CASE action WHEN 'native_prompt' THEN trim(question) ELSE '{V.PREMISE_INSTRUCTION}' || chr(10) || chr(10) || 'Question: ' || trim(question) END) AS prompt FROM qa, (SELECT unnest(['native_prompt', 'premise_verification']) AS action)"))
def p9(spark, sf):
    rows = _expanded(B.qa(spark, sf), "action", ("native_prompt", "premise_verification"))
    return rows.select("image_id", "action", F.md5(T.prompt(F.col("question"), F.col("action"))).alias("prompt"))


@query("P11_first_line", "SELECT doc_id, md5(trim(string_split(text, chr(10))[1])) AS first_line FROM documents")
def p11(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(T.first_line(F.col("text"))).alias("first_line"))


@query("P12_text_or_json", """SELECT image_id, CASE WHEN image_id % 2 = 0 THEN '' ELSE condition END AS said, image_id::VARCHAR AS number, '["' || condition || '", ' || CASE WHEN image_id % 3 = 0 THEN 'null' ELSE '"a\\"b"' END || ']' AS list, CASE WHEN image_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '{"kind": "' || conflict_type || '", "ids": [' || image_id || ']}' AS whole
FROM (SELECT user_id AS image_id, event_type AS condition, CASE WHEN user_id % 2 = 0 THEN 'object' ELSE 'relation' END AS conflict_type FROM events GROUP BY ALL)""")
def p12(spark, sf):
    rows = B.scores(spark, sf).select(
        "image_id", F.when(F.col("image_id") % 2 != 0, F.col("condition")).alias("said"), F.col("image_id").alias("number"),
        F.array("condition", F.when(F.col("image_id") % 3 != 0, 'a"b')).alias("list"), (F.col("image_id") % 2 == 0).alias("flag"), F.struct(F.col("conflict_type").alias("kind"), F.array("image_id").alias("ids")).alias("whole"),
    )
    return rows.select("image_id", *[io.text_or_json(rows, c).alias(c) for c in rows.columns[1:]])


@query("P13_metadata_columns", "SELECT item_id, 'v1' AS protocol FROM benchmark")
def p13(spark, sf):
    return B.table(spark, sf, "benchmark").drop("text").withColumn("protocol", F.lit("v1"))


@query("P14_normalized_label", "SELECT label, count(*) AS n FROM (SELECT lower(trim(coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '  ' || upper(lang) || ' ' END, ''))) AS label FROM documents) GROUP BY label")
def p14(spark, sf):
    raw = B.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  "), F.upper("lang"), F.lit(" "))).alias("raw"))
    return S.histogram(raw.select(R.label("raw").alias("label")), "label")


def _leave_one_out_sql(p: str, g: str) -> str:
    return f"round(list_avg(list_transform(range(1, len({g}) + 1), lambda i: least(1.0, len(list_filter(range(1, len({g}) + 1), lambda j: j <> i AND {g}[j] = {p})) / 3.0))), 6)"


@query("P16_evaluate_answers", B.with_sql("answers", f"""SELECT question_id, 'v1' AS protocol, {_leave_one_out_sql('CASE WHEN d THEN np ELSE majority END', 'CASE WHEN d THEN ng ELSE answers END')} AS accuracy, {_leave_one_out_sql('np', 'ng')} AS normalized_accuracy, regexp_matches(majority, '(?i)not shown') AS refusal
FROM (SELECT *, len(list_distinct(answers)) > 1 AS d, list_transform(answers, lambda p: {P.NORMAL_SQL}) AS ng, {P.NORMAL_SQL} AS np FROM (SELECT *, majority AS p FROM answers))"""))
def p16(spark, sf):
    rows = B.answers(spark, sf)
    said, answers = F.col("majority"), F.col("answers")
    return rows.select("question_id", F.lit("v1").alias("protocol"), r6(T.official_accuracy(said, answers)).alias("accuracy"), r6(T.normalized_accuracy(said, answers)).alias("normalized_accuracy"), T.generic_refusal(said).alias("refusal"))


@query("P17_scope", B.with_sql("labeled", "SELECT 'pooled' AS scope, count(*) AS n FROM labeled UNION ALL SELECT 'fr', count(*) FROM labeled WHERE stratum = 'fr'"))
def p17(spark, sf):
    rows = B.labeled(spark, sf)
    parts = [io.scoped(rows, "stratum", s).groupBy(F.lit(s).alias("scope")).agg(F.count(F.lit(1)).alias("n")) for s in ("pooled", "fr")]
    return parts[0].union(parts[1])


@query("P18_availability", "SELECT CASE WHEN n_chars = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'unavailable' ELSE 'available' END = 'available' AS available, count(*) AS n FROM documents GROUP BY ALL")
def p18(spark, sf):
    status = F.when(F.col("n_chars") == 0, "failed").when(F.col("doc_id") % 7 == 0, "unavailable").otherwise("available")
    return B.table(spark, sf, "documents").groupBy((status == "available").alias("available")).agg(F.count(F.lit(1)).alias("n"))


@query("V1_duplicate_keys", "SELECT text_hash, count(*) AS n_rows FROM (SELECT md5(text) AS text_hash FROM documents) GROUP BY ALL HAVING count(*) > 1")
def v1(spark, sf):
    return C.duplicate_keys(B.table(spark, sf, "documents").select(F.md5("text").alias("text_hash")), ["text_hash"])


@query("V2_key_set_difference", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def v2(spark, sf):
    return C.key_set_difference(B.table(spark, sf, "documents"), B.table(spark, sf, "labels"), ["doc_id"])


@query("V3_incomplete_sets", "SELECT conv_id, array_to_string(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(g, r)), ',') AS missing FROM (SELECT conv_id, list(DISTINCT role) AS g FROM conversations GROUP BY conv_id) WHERE len(list_filter(['assistant', 'system', 'user'], lambda r: NOT list_contains(g, r))) > 0")
def v3(spark, sf):
    return C.incomplete_sets(B.table(spark, sf, "conversations"), "conv_id", "role", ["assistant", "system", "user"])


@query("V4_unequal_values", "SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def v4(spark, sf):
    return C.unequal_values(B.table(spark, sf, "documents"), "source", "lang")


@query("V5_pairs", "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_clean, count(*) FILTER (event_type <> 'click') AS n_conflict FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') <> 1 OR count(*) FILTER (event_type <> 'click') <> 1")
def v5(spark, sf):
    rows = B.table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return C.not_paired(rows, "user_id", "kind")


@query("V6_domain", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'de')")
def v6(spark, sf):
    return C.not_in_domain(B.table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["en", "fr", "de"])


@query("V7_label_rules", B.with_sql("gen", """SELECT image_id, condition, array_to_string(list_filter([CASE WHEN condition = 'text_only_conflict' AND semantic NOT IN ('', 'n/a') THEN 'text_only_has_no_semantic' END, CASE WHEN condition = 'multimodal_clean' AND stance NOT IN ('', 'n/a') THEN 'clean_has_no_stance' END,
 CASE WHEN condition <> 'text_only_conflict' AND semantic = 'n/a' THEN 'semantic_applies' END, CASE WHEN condition <> 'multimodal_clean' AND stance = 'n/a' THEN 'stance_applies' END], lambda x: x IS NOT NULL), ',') AS broken
 FROM (SELECT image_id, condition, CASE image_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'n/a' ELSE '' END AS semantic, CASE image_id % 2 WHEN 0 THEN 'n/a' ELSE 'other' END AS stance FROM gen) WHERE broken <> ''"""))
def v7(spark, sf):
    semantic, how = F.when(F.col("image_id") % 3 == 0, "yes").when(F.col("image_id") % 3 == 1, "n/a").otherwise(""), F.when(F.col("image_id") % 2 == 0, "n/a").otherwise("other")
    rows = B.generations(spark, sf).select("image_id", "condition", semantic.alias("semantic"), how.alias("how"))
    return C.broken_rules(rows, R.semantic_rules(F.col("semantic"), F.col("how"), F.col("condition"))).select("image_id", "condition", "broken")


LABELS = "CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'uncertain' END AS a, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'uncertain' END AS b"
EFFECT = "CASE WHEN a = 'uncertain' OR b = 'uncertain' THEN 'uncertain' WHEN a = 'no' AND b = 'yes' THEN 'intervention_helps' WHEN a = 'yes' AND b = 'no' THEN 'intervention_harms' ELSE 'semantic_tie' END"


def _labels(spark, sf):
    key = F.col("doc_id")
    a = F.when(key % 3 == 0, "yes").when(key % 3 == 1, "no").otherwise("uncertain")
    b = F.when(key % 4 == 0, "yes").when(key % 4 == 1, "no").when(key % 4 == 2, "yes").otherwise("uncertain")
    return B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", a.alias("a"), b.alias("b"))


@query("V8_derived_label", f"SELECT doc_id, 'semantic_tie' AS claimed, {EFFECT} AS expected FROM (SELECT doc_id, {LABELS} FROM documents) WHERE {EFFECT} <> 'semantic_tie'")
def v8(spark, sf):
    rows = _labels(spark, sf).withColumn("claimed", F.lit("semantic_tie"))
    return C.wrong_derivation(rows, "claimed", R.effect_of_labels(F.col("a"), F.col("b"))).select("doc_id", "claimed", "expected")


@query("V9_partial_group", "SELECT doc_id, filled FROM (SELECT doc_id, (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS filled FROM documents) WHERE filled BETWEEN 1 AND 2")
def v9(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", *[F.when(F.col("doc_id") % m == 0, "x").otherwise(" ").alias(f"c{m}") for m in (2, 3, 5)])
    return C.partial_groups(rows, ["c2", "c3", "c5"]).select("doc_id", "filled")


@query("V10_audit_scope", """WITH a AS (SELECT doc_id, 'good' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'clean' FROM labels WHERE toxic = 0 AND doc_id % 5 = 0), g AS (SELECT doc_id, count(DISTINCT label) AS n FROM a GROUP BY doc_id),
x AS (SELECT doc_id FROM labels WHERE quality = 1 OR doc_id % 10 = 3) SELECT doc_id, 'several groups' AS problem FROM g WHERE n > 1 UNION ALL SELECT doc_id, 'unknown' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 50 <> 1)
UNION ALL SELECT doc_id, 'missing' FROM x WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT doc_id, 'extra' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM x)""")
def v10(spark, sf):
    labels = B.table(spark, sf, "labels")
    audit = labels.where("quality = 1").select("doc_id", F.lit("good").alias("label")).unionByName(labels.where("toxic = 0 AND doc_id % 5 = 0").select("doc_id", F.lit("clean").alias("label")))
    known, expected = B.table(spark, sf, "documents").where("doc_id % 50 <> 1"), labels.where("quality = 1 OR doc_id % 10 = 3")
    return C.audit_scope(audit, "label", "doc_id", known, expected)


@query("V11_functional", "SELECT text_hash, count(DISTINCT source) AS n_values FROM (SELECT md5(text) AS text_hash, source FROM documents) GROUP BY ALL HAVING count(DISTINCT source) > 1")
def v11(spark, sf):
    return C.not_functional(B.table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "source"), "text_hash", "source")


@query("V12_finite_and_classes", B.with_sql("labeled", "SELECT effect, count(*) AS n_rows FROM labeled GROUP BY effect HAVING count(*) < 50"))
def v12(spark, sf):
    rows = B.labeled(spark, sf)
    finite = rows.join(C.not_finite(rows, ["probability"]).select("id"), "id", "left_anti")
    return C.small_classes(finite, "effect", 50)


@query("V13_group_leak", B.with_sql("labeled", "SELECT image_hash FROM labeled WHERE effect = 'helps' INTERSECT SELECT image_hash FROM labeled WHERE effect <> 'helps'"))
def v13(spark, sf):
    rows = B.labeled(spark, sf)
    return C.leaked_groups(rows.where("effect = 'helps'"), rows.where("effect <> 'helps'"), "image_hash")


@query("J1_aligned_pairs", P.B.with_sql("gen", "SELECT a.image_id, a.prediction = b.prediction AS same FROM gen a JOIN gen b ON a.image_id = b.image_id AND a.condition = 'multimodal_conflict' AND b.condition = 'multimodal_clean'"))
def j1(spark, sf):
    rows = B.generations(spark, sf)
    one, two = rows.where("condition = 'multimodal_conflict'").select("image_id", "prediction"), rows.where("condition = 'multimodal_clean'").select("image_id", F.col("prediction").alias("other"))
    return J.aligned(one, two, ["image_id"]).select("image_id", (F.col("prediction") == F.col("other")).alias("same"))


@query("J2_three_way", B.with_sql("scores", "SELECT a.image_id, round(a.score - b.score, 6) AS change, c.score AS feature FROM scores a JOIN scores b USING (image_id) JOIN scores c USING (image_id) WHERE a.condition = 'view' AND b.condition = 'click' AND c.condition = 'error'"))
def j2(spark, sf):
    rows = B.scores(spark, sf)
    a, b, c = (rows.where(F.col("condition") == x).select("image_id", F.col("score").alias(x)) for x in ("view", "click", "error"))
    return J.aligned(J.aligned(a, b, ["image_id"]), c, ["image_id"]).select("image_id", r6(F.col("view") - F.col("click")).alias("change"), F.col("error").alias("feature"))


@query("J3_pair_by_condition", P.B.with_sql("gen", f", {P.STANCE_SQL} SELECT image_id, max(stance) FILTER (condition = 'multimodal_conflict') AS stance_multimodal_conflict, max(stance) FILTER (condition = 'text_only_conflict') AS stance_text_only_conflict FROM st GROUP BY image_id"))
def j3(spark, sf):
    return J.wide(P._stances(spark, sf), "image_id", "condition", ["multimodal_conflict", "text_only_conflict"], ["stance"])


WIDE = "w AS (SELECT image_id, any_value(conflict_type) AS conflict_type, max(score) FILTER (condition = 'view') AS v, max(score) FILTER (condition = 'click') AS c, max(score) FILTER (condition = 'signup') AS s, max(score) FILTER (condition = 'purchase') AS p FROM scores GROUP BY image_id)"


def _deltas(spark, sf):
    rows = J.wide(B.scores(spark, sf), "image_id", "condition", list(B.SCORE_CONDITIONS), ["score"])
    kind = F.when(F.col("image_id") % 2 == 0, "object").otherwise("relation")
    conflict, clean = F.col("score_view") - F.col("score_click"), F.col("score_signup") - F.col("score_purchase")
    return rows.select("image_id", kind.alias("conflict_type"), conflict.alias("conflict_delta"), clean.alias("clean_delta"), (conflict - clean).alias("difference"))


DELTAS = f"{WIDE}, d AS (SELECT image_id, conflict_type, v - c AS conflict_delta, s - p AS clean_delta, (v - c) - (s - p) AS difference FROM w)"


@query("J4_pair_deltas", B.with_sql("scores", f", {DELTAS} SELECT image_id, round(conflict_delta, 6) AS conflict_delta, round(clean_delta, 6) AS clean_delta, round(difference, 6) AS difference FROM d"))
def j4(spark, sf):
    return _deltas(spark, sf).select("image_id", *[r6(c).alias(c) for c in ("conflict_delta", "clean_delta", "difference")])


@query("J5_base_and_perturbed", B.with_sql("scores", "SELECT a.image_id, b.condition AS perturbation, round(a.score - b.score, 6) AS drop FROM scores a JOIN scores b USING (image_id) WHERE a.condition = 'view' AND b.condition IN ('click', 'signup')").replace(" AS drop", ' AS "fall"'))
def j5(spark, sf):
    rows = B.scores(spark, sf)
    base = rows.where("condition = 'view'").select("image_id", F.col("score").alias("base"))
    other = rows.where(F.col("condition").isin("click", "signup")).select("image_id", F.col("condition").alias("perturbation"), "score")
    return other.join(base, "image_id").select("image_id", "perturbation", r6(F.col("base") - F.col("score")).alias("fall"))


ACTIONS_SQL = f"{P.VERDICT_SQL}, ac AS (SELECT image_id, max(u) FILTER (condition = 'multimodal_conflict') AS before, max(u) FILTER (condition = 'text_only_conflict') AS after FROM (SELECT *, CASE verdict WHEN 'correct' THEN 1 WHEN 'incorrect' THEN 0 END AS u FROM vd) GROUP BY image_id), ef AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'uncertain' WHEN after > before THEN 'helps' WHEN after < before THEN 'harms' ELSE 'tie' END AS effect FROM ac)"


def _actions(spark, sf):
    rows = J.wide(P._verdicts(spark, sf), "image_id", "condition", ["multimodal_conflict", "text_only_conflict"], ["utility"])
    return rows.select("image_id", F.col("utility_multimodal_conflict").alias("before"), F.col("utility_text_only_conflict").alias("after")).withColumn("effect", R.effect_of_utilities(F.col("before"), F.col("after")))


@query("J6_pair_actions", B.with_sql("gen", f", {ACTIONS_SQL} SELECT image_id, before, after, effect FROM ef"))
def j6(spark, sf):
    return _actions(spark, sf)


@query("J7_audited_samples", B.with_sql("labeled", "SELECT id, effect AS label, stratum, source || ':' || score AS said FROM labeled WHERE effect <> 'tie'"))
def j7(spark, sf):
    rows = B.labeled(spark, sf)
    # audit documents of up to fifty ids, each a map of label -> ids
    ids = [F.struct(F.lit(e), F.sort_array(F.collect_list(F.when(F.col("effect") == e, F.col("id"))))) for e in ("helps", "harms", "tie")]
    audit = J.exploded_groups(rows.groupBy(F.floor(F.col("id") / 50)).agg(F.map_from_entries(F.array(*ids)).alias("groups")), "groups")
    predictions = rows.select("id", F.explode(F.array(F.lit("native_prompt"), F.lit("other"))).alias("action"), F.concat_ws(":", "source", F.col("score").cast("string")).alias("said"))
    found = J.audited(rows.select("id", "stratum"), predictions.where("action = 'native_prompt'").drop("action"), audit, "id", "said", ["helps", "harms"])
    return found.select("id", "label", "stratum", "said")


@query("J8_equal_sets", B.with_sql("scores", "SELECT a.image_id, a.score AS x, b.score AS y FROM scores a JOIN scores b USING (image_id) WHERE a.condition = 'view' AND b.condition = 'error'"))
def j8(spark, sf):
    rows = B.scores(spark, sf)
    return J.aligned(rows.where("condition = 'view'").select("image_id", F.col("score").alias("x")), rows.where("condition = 'error'").select("image_id", F.col("score").alias("y")), ["image_id"])


@query("J9_foreign_key", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j9(spark, sf):
    orders, customers = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    C.assert_empty(orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_custkey"), "orders without customers")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("J10_optional", "SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'good' ELSE 'bad' END, 'none') AS mark FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id".replace("CASE quality WHEN 1 THEN 'good' ELSE 'bad' END", "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END"))
def j10(spark, sf):
    marks = B.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("mark"))
    return J.optional(B.table(spark, sf, "documents").select("doc_id"), marks, "doc_id", "mark", F.lit("none"))


@query("J11_many_to_one", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j11(spark, sf):
    nations = J.broadcast_if_small(B.table(spark, sf, "nation"))
    return B.table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("J13_present", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j13(spark, sf):
    return B.table(spark, sf, "events").join(B.table(spark, sf, "customer").where("c_acctbal > 0"), F.col("user_id") == F.col("c_custkey"), "left_semi").select("user_id").distinct()


@query("J14_leak_control", B.with_sql("labeled", "SELECT id FROM labeled WHERE stratum = 'en' AND image_hash NOT IN (SELECT image_hash FROM labeled WHERE stratum <> 'en' OR before = 1)"))
def j14(spark, sf):
    rows = B.labeled(spark, sf)
    return J.without_shared_groups(rows.where("stratum = 'en'"), rows.where("stratum <> 'en' OR before = 1"), "image_hash").select("id")


@query("J15_upsert", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 'old' END, CASE WHEN l.doc_id % 2 = 1 THEN 'new' END) AS mark FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j15(spark, sf):
    base = B.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "old").alias("mark"))
    changes = B.table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 1, "new").alias("mark"))
    return J.upsert(base, changes, "doc_id", ["mark"])


@query("A1_group_summary", B.with_sql("qa", f", {P.LEX_SQL} SELECT conflict_type, count(*) AS n, round(avg(normalized_exact_match::INT), 6) AS exact, round(avg(token_f1), 6) AS f1, round(avg(token_recall), 6) AS recall FROM lex GROUP BY conflict_type"))
def a1(spark, sf):
    rows = P._lexical(spark, sf)
    return rows.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("normalized_exact_match").cast("double"))).alias("exact"), r6(F.avg("token_f1")).alias("f1"), r6(F.avg("token_recall")).alias("recall"))


@query("A2_grouping_sets", B.with_sql("gen", f", {P.EVAL_SQL} SELECT CASE WHEN grouping(condition) = 1 THEN '(all)' ELSE condition END AS condition, CASE WHEN grouping(conflict_type) = 1 THEN '(all)' ELSE conflict_type END AS conflict_type, count(*) AS n, round(avg(token_f1), 6) AS f1, count(*) FILTER (conflict AND raw_stance = 'reject_premise') AS rejects FROM ev GROUP BY GROUPING SETS ((), (condition), (condition, conflict_type))"))
def a2(spark, sf):
    metrics = {"n": F.count(F.lit(1)), "f1": r6(F.avg("token_f1")), "rejects": F.count_if(F.col("stance") == "reject_premise")}
    return S.grouped(P._evaluated(spark, sf), [[], ["condition"], ["condition", "conflict_type"]], metrics)


@query("A3_transitions", B.with_sql("gen", f', {P.STANCE_SQL} SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (NOT a AND b) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT image_id, bool_or(stance = \'reject_premise\' AND condition = \'multimodal_conflict\') AS a, bool_or(stance = \'reject_premise\' AND condition = \'text_only_conflict\') AS b FROM st GROUP BY image_id)'))
def a3(spark, sf):
    rows = J.wide(P._stances(spark, sf), "image_id", "condition", ["multimodal_conflict", "text_only_conflict"], ["stance"])
    a, b = F.col("stance_multimodal_conflict") == "reject_premise", F.col("stance_text_only_conflict") == "reject_premise"
    return rows.agg(*named(S.transitions(a, b)))


@query("A4_histogram", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a4(spark, sf):
    return S.histogram(B.table(spark, sf, "documents"), "source")


@query("A7_signs", B.with_sql("scores", f", {DELTAS} SELECT count(difference) AS n, count(*) FILTER (difference > 0) AS positive, count(*) FILTER (difference < 0) AS negative, count(*) FILTER (difference = 0) AS zero, round(count(*) FILTER (difference > 0) / count(difference), 6) AS positive_rate, round(coalesce(count(*) FILTER (difference > 0) / nullif(count(*) FILTER (difference <> 0), 0), 0), 6) AS nonzero_positive_rate FROM d"))
def a7(spark, sf):
    found = S.signs(F.col("difference"))
    return _deltas(spark, sf).agg(*[r6(c).alias(n) if n.endswith("rate") else c.alias(n) for n, c in found.items()])


@query("A8_by_condition", B.with_sql("scores", "SELECT condition, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM scores GROUP BY condition"))
def a8(spark, sf):
    return B.scores(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean"), r6(F.median("score")).alias("median"))


@query("A9_by_type", B.with_sql("scores", f", {DELTAS} SELECT CASE WHEN grouping(conflict_type) = 1 THEN '(all)' ELSE conflict_type END AS conflict_type, count(*) AS n, round(avg(difference), 6) AS mean FROM d GROUP BY GROUPING SETS ((), (conflict_type))"))
def a9(spark, sf):
    return S.grouped(_deltas(spark, sf), [[], ["conflict_type"]], {"n": F.count(F.lit(1)), "mean": r6(F.avg("difference"))})


@query("A10_verdict_rates", B.with_sql("gen", f", {P.VERDICT_SQL} SELECT condition, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'uncertain') AS uncertain, round(count(*) FILTER (verdict = 'correct') / count(*), 6) AS rate_all, round(count(*) FILTER (verdict = 'correct') / nullif(count(*) FILTER (verdict <> 'uncertain'), 0), 6) AS rate_decisive FROM vd GROUP BY condition"))
def a10(spark, sf):
    found = S.verdicts(F.col("verdict"))
    return P._verdicts(spark, sf).groupBy("condition").agg(*[r6(c).alias(n) if n.startswith("rate") else c.alias(n) for n, c in found.items()])


EFFECTS = "count(*) AS n, count(*) FILTER (effect = 'helps') AS helps, count(*) FILTER (effect = 'harms') AS harms, count(*) FILTER (effect = 'tie') AS tie, count(*) FILTER (effect = 'uncertain') AS uncertain, round(count(*) FILTER (effect = 'helps') / nullif(count(*) FILTER (effect = 'harms'), 0), 6) AS helps_per_harm"


@query("A11_paired_effects", B.with_sql("gen", f", {ACTIONS_SQL} SELECT {EFFECTS} FROM ef"))
def a11(spark, sf):
    found = S.effects(F.col("effect"))
    return _actions(spark, sf).agg(*[r6(c).alias(n) if n == "helps_per_harm" else c.alias(n) for n, c in found.items()])


@query("A12_best_over_variants", "SELECT conv_id, turn, max(length(trim(v))) AS longest, bool_or(trim(v) LIKE 'the%') AS any_the FROM (SELECT conv_id, turn, unnest(string_split(replace(text, chr(10), ' '), ',')) AS v FROM conversations) GROUP BY ALL")
def a12(spark, sf):
    parts = F.transform(F.split(F.translate("text", "\n", " "), ","), lambda x: F.trim(x))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", S.best_of(parts, F.char_length).alias("longest"), F.exists(parts, lambda x: F.startswith(x, F.lit("the"))).alias("any_the"))


@query("A13_category_summary", B.with_sql("gen", f", {P.EVAL_SQL}, {P.PAIR_SQL} SELECT kind, count(*) AS n, count(*) FILTER (change > 0.1) AS wins, count(*) FILTER (change < -0.1) AS losses, round(avg(change), 6) AS mean_change FROM pr GROUP BY kind"))
def a13(spark, sf):
    return P._pairs(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") > 0.1).alias("wins"), F.count_if(F.col("change") < -0.1).alias("losses"), r6(F.avg("change")).alias("mean_change"))


@query("A14_confusion", B.with_sql("labeled", "SELECT stratum, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM (SELECT stratum, count(*) FILTER (target AND g) AS tp, count(*) FILTER (NOT target AND g) AS fp, count(*) FILTER (target AND NOT g) AS fn, count(*) FILTER (NOT target AND NOT g) AS tn FROM (SELECT *, probability > 0.5 AS g FROM labeled) GROUP BY stratum)"))
def a14(spark, sf):
    found = S.confusion(F.col("target"), F.col("probability") > 0.5)
    return B.labeled(spark, sf).groupBy("stratum").agg(*[r6(c).alias(n) if n in ("precision", "recall", "accuracy") else c.alias(n) for n, c in found.items()])


@query("A15_decided_rate", f"SELECT lang, count(*) FILTER (a <> 'uncertain') AS decided, round(count(*) FILTER (a = 'yes') / nullif(count(*) FILTER (a <> 'uncertain'), 0), 6) AS rate FROM (SELECT lang, {LABELS} FROM documents) GROUP BY lang")
def a15(spark, sf):
    decided = F.count_if(F.col("a") != "uncertain")
    return _labels(spark, sf).groupBy("lang").agg(decided.alias("decided"), r6(S.rate(F.count_if(F.col("a") == "yes"), decided)).alias("rate"))


@query("A16_consensus", B.with_sql("answers", "SELECT question_id, len(list_filter(answers, lambda x: x = majority)) AS consensus FROM answers"))
def a16(spark, sf):
    return B.answers(spark, sf).select("question_id", long(F.size(F.filter("answers", lambda x: x == F.col("majority")))).alias("consensus"))


@query("A17_nested_summary", "SELECT CASE WHEN grouping(role) = 1 THEN '(all)' ELSE role END AS role, CASE WHEN grouping(kind) = 1 THEN '(all)' ELSE kind END AS kind, count(*) AS n, round(avg(length(text)), 6) AS mean FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM conversations) GROUP BY GROUPING SETS ((role), (kind), (role, kind))")
def a17(spark, sf):
    rows = B.table(spark, sf, "conversations").withColumn("kind", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    return S.grouped(rows, [["role"], ["kind"], ["role", "kind"]], {"n": F.count(F.lit(1)), "mean": r6(F.avg(F.char_length("text")))}).select("role", "kind", "n", "mean")


@query("A18_runtime", "SELECT event_type, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY event_type")
def a18(spark, sf):
    return B.table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), r6(F.avg("value")).alias("mean"), F.max("value").alias("high"))


@query("A19_coverage", "SELECT source, count(*) AS n, count(*) FILTER (n_chars > 500) AS available, round(count(*) FILTER (n_chars > 500) / count(*), 6) AS coverage FROM documents GROUP BY source")
def a19(spark, sf):
    found = S.coverage(F.col("n_chars") > 500)
    return B.table(spark, sf, "documents").groupBy("source").agg(*[r6(c).alias(n) if n == "coverage" else c.alias(n) for n, c in found.items()])


@query("A19_failed_ids", "SELECT source, doc_id FROM documents WHERE NOT n_chars > 500 ORDER BY source, doc_id")
def a19_failed(spark, sf):
    return S.failed(B.table(spark, sf, "documents"), F.col("n_chars") > 500, "doc_id", ["source"])


@query("A20_distinct", "SELECT count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources FROM documents")
def a20(spark, sf):
    return B.table(spark, sf, "documents").agg(F.count_distinct("text").alias("n_texts"), F.count_distinct("source").alias("n_sources"))


@query("A23_sensitivity", B.with_sql("labeled", "SELECT 'all' AS variant, count(*) AS n, round(avg(score), 6) AS mean FROM labeled UNION ALL SELECT 'confirmed', count(*), round(avg(score), 6) FROM labeled WHERE NOT (before = 1)"))
def a23(spark, sf):
    return S.with_and_without(B.labeled(spark, sf), F.col("before") == 1, {"n": F.count(F.lit(1)), "mean": r6(F.avg("score"))})


@query("A27_fixed_categories", "SELECT c.lang, count(d.doc_id) AS n FROM (SELECT unnest(['en', 'xx']) AS lang) c LEFT JOIN documents d USING (lang) GROUP BY c.lang")
def a27(spark, sf):
    return S.filled_categories(B.table(spark, sf, "documents"), "lang", ["en", "xx"], {"n": F.count(F.lit(1))})


@query("A31_multiplicity", "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text)) GROUP BY n")
def a31(spark, sf):
    return B.table(spark, sf, "documents").groupBy(F.md5("text")).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


@query("X1_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def x1(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id").subtract(B.table(spark, sf, "labels").select("doc_id"))


@query("X2_intersection", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def x2(spark, sf):
    docs = B.table(spark, sf, "documents")
    return docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'fr'").select("source"))


@query("X3_union", "SELECT origin, count(*) AS n FROM (SELECT 'd' AS origin FROM documents UNION ALL SELECT 'b' FROM benchmark) GROUP BY origin")
def x3(spark, sf):
    rows = B.table(spark, sf, "documents").select(F.lit("d").alias("origin"), "text").unionByName(B.table(spark, sf, "benchmark").select(F.lit("b").alias("origin"), "text"))
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("X4_subset", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS subset")
def x4(spark, sf):
    outside = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents"), "doc_id", "left_anti")
    return outside.agg((F.count(F.lit(1)) == 0).alias("subset"))


@query("X5_multiset_intersection", B.with_sql("qa", f"SELECT image_id, ({P.SHARED})::BIGINT AS shared FROM qa"))
def x5(spark, sf):
    return B.qa(spark, sf).select("image_id", long(T.shared_tokens(F.col("pred_words"), F.col("ref_words"))).alias("shared"))


@query("F24_action_effect", f"SELECT doc_id, {EFFECT} AS effect FROM (SELECT doc_id, {LABELS} FROM documents)")
def f24(spark, sf):
    return _labels(spark, sf).select("doc_id", R.effect_of_labels(F.col("a"), F.col("b")).alias("effect"))


SECOND = "CASE doc_id % 5 WHEN 0 THEN 'intervention_helps' WHEN 1 THEN 'intervention_harms' WHEN 2 THEN 'uncertain' ELSE 'semantic_tie' END"


@query("F25_overall_action", f"SELECT doc_id, CASE WHEN x = 'uncertain' OR y = 'uncertain' OR (x = 'intervention_helps' AND y = 'intervention_harms') THEN 'uncertain' WHEN x = 'intervention_helps' THEN 'choose_intervention' WHEN x = 'intervention_harms' THEN 'choose_native' WHEN y = 'intervention_helps' THEN 'choose_intervention' WHEN y = 'intervention_harms' THEN 'choose_native' ELSE 'either' END AS action FROM (SELECT doc_id, {EFFECT} AS x, {SECOND} AS y FROM (SELECT doc_id, {LABELS} FROM documents))")
def f25(spark, sf):
    key = F.col("doc_id") % 5
    second = F.when(key == 0, "intervention_helps").when(key == 1, "intervention_harms").when(key == 2, "uncertain").otherwise("semantic_tie")
    return _labels(spark, sf).select("doc_id", R.overall_action(R.effect_of_labels(F.col("a"), F.col("b")), second).alias("action"))


@query("F26_effect_of_utilities", B.with_sql("gen", f", {ACTIONS_SQL} SELECT effect, count(*) AS n FROM ef GROUP BY effect"))
def f26(spark, sf):
    return S.histogram(_actions(spark, sf), "effect")


@query("F27_effect_with_epsilon", B.with_sql("scores", f", {WIDE} SELECT image_id, CASE WHEN c - v > 1e-12 THEN 'helps' WHEN v - c > 1e-12 THEN 'harms' ELSE 'tie' END AS effect FROM w"))
def f27(spark, sf):
    rows = J.wide(B.scores(spark, sf), "image_id", "condition", ["view", "click"], ["score"])
    return rows.select("image_id", J.effect(F.col("score_view"), F.col("score_click"), 1e-12).alias("effect"))


@query("F28_resolved_label", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN a WHEN 1 THEN b END AS label FROM (SELECT doc_id, {LABELS} FROM documents)")
def f28(spark, sf):
    confirmation = F.when(F.col("doc_id") % 6 == 0, "accept").when(F.col("doc_id") % 6 == 1, "edit").otherwise("")
    return _labels(spark, sf).select("doc_id", R.resolved(F.col("a"), F.col("b"), confirmation).alias("label"))


@query("F29_bulk_confirm", "SELECT count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 3 IN (0, 1)) AS changed, count(*) FILTER (doc_id % 4 = 0 OR doc_id % 3 IN (0, 1)) AS confirmed FROM documents")
def f29(spark, sf):
    confidence = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = B.table(spark, sf, "documents").select("doc_id", confidence.alias("ai_confidence"), F.when(F.col("doc_id") % 4 == 0, "edit").alias("human_confirmation"))
    done = R.confirm(rows, F.col("ai_confidence").isin("low", "medium"))
    return done.agg(F.count_if("changed").alias("changed"), F.count_if(R.label("human_confirmation") != "").alias("confirmed"))


STANCE_IDS = {"answer_premise": [1, 4, 7, 20], "reject_premise": [2, 5, 40, 41], "other": [3, 60]}
CONFIDENCE_IDS = {"low": [1, 2, 3, 4], "high": [5, 6, 7, 8, 9]}
NOTES = {"rejects": "names what the image lacks", "right": "right without a rejection", "wrong": "takes the premise", "clean_right": "agrees with the reference", "clean_wrong": "does not agree"}


def _sets_sql(sets: dict[str, list[int]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN doc_id IN ({', '.join(map(str, ids))}) THEN '{name}'" for name, ids in sets.items()) + f" ELSE '{default}' END"


@query("F30_dimension_lookup", f"""SELECT doc_id, how, confidence, CASE doc_id % 3 WHEN 0 THEN CASE WHEN a = 'yes' THEN '{NOTES["clean_right"]}' ELSE '{NOTES["clean_wrong"]}' END WHEN 1 THEN CASE WHEN a = 'yes' AND how = 'reject_premise' THEN '{NOTES["rejects"]}' WHEN a = 'yes' THEN '{NOTES["right"]}' ELSE '{NOTES["wrong"]}' END ELSE '' END AS note
FROM (SELECT doc_id, {_sets_sql(STANCE_IDS, 'abstain')} AS how, {_sets_sql(CONFIDENCE_IDS, 'medium')} AS confidence, {LABELS} FROM documents)""")
def f30(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("multimodal_clean", "multimodal_conflict", "text_only_conflict"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _labels(spark, sf).select("doc_id", "a", kind.alias("condition"), R.by_id_sets(F.col("doc_id"), STANCE_IDS, "abstain").alias("how"), R.by_id_sets(F.col("doc_id"), CONFIDENCE_IDS, "medium").alias("confidence"))
    return rows.select("doc_id", "how", "confidence", R.default_note(F.col("a"), F.col("how"), F.col("condition"), NOTES).alias("note"))


@query("F31_confirmed_exclusions", f"SELECT doc_id FROM (SELECT doc_id, {LABELS} FROM documents) WHERE a = 'no' AND doc_id % 6 IN (0, 1)")
def f31(spark, sf):
    return _labels(spark, sf).where((F.col("a") == "no") & (F.col("doc_id") % 6).isin(0, 1)).select("doc_id")


@query("F32_completeness", f"SELECT lang, CASE WHEN bool_and(a <> 'uncertain') THEN 'complete' ELSE 'incomplete' END AS status FROM (SELECT lang, {LABELS} FROM documents) GROUP BY lang")
def f32(spark, sf):
    return _labels(spark, sf).groupBy("lang").agg(F.when(F.bool_and(F.col("a") != "uncertain"), "complete").otherwise("incomplete").alias("status"))


@query("F33_padded_path", "SELECT doc_id, 'img_' || lpad(doc_id::VARCHAR, 12, '0') || '.jpg' AS path FROM documents")
def f33(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("img_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("path"))


@query("F34_split_decided", f"SELECT doc_id, CASE WHEN a IN ('yes', 'no') THEN 'kept' ELSE 'excluded' END AS status, CASE WHEN a = 'uncertain' THEN 'label is uncertain' ELSE '' END AS reason FROM (SELECT doc_id, {LABELS} FROM documents)")
def f34(spark, sf):
    return R.split_decided(_labels(spark, sf), "a").select("doc_id", "status", "reason")

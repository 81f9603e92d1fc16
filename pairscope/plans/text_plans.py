"""Queries of text kernels and per-record evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairscope.functions import arrays as A
from pairscope.functions import text as T
from pairscope.functions import vocabulary as V
from pairscope.operators import review as R
from pairscope.plans.base import long, query, r6
from pairscope.sources import bindings as B


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words) -> str:
    return ", ".join(map(_q, words))



@query("F1_normalize_text", f"SELECT item_id, array_to_string({B.tokens_sql('text')}, ' ') AS normalized FROM benchmark")
def f1(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", T.normalized(F.col("text")).alias("normalized"))


@query("F2_tokenize", f"SELECT conv_id, turn, len({B.tokens_sql('text')})::BIGINT AS n_tokens, md5(array_to_string({B.tokens_sql('text')}, ' ')) AS digest FROM conversations")
def f2(spark, sf):
    words = B.table(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("words"))
    return words.select("conv_id", "turn", long(F.size("words")).alias("n_tokens"), F.md5(F.array_join("words", " ")).alias("digest"))


LCS_SQL = """r AS (SELECT image_id, pred_words AS a, ref_words AS b, 0 AS i, list_transform(ref_words, lambda x: 0) AS line FROM qa
UNION ALL SELECT image_id, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: greatest(line[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda p: b[p] = a[i + 1]), lambda p: CASE WHEN p = 1 THEN 0 ELSE line[p - 1] END + 1)), 0))) FROM r WHERE i < len(a)),
l AS (SELECT image_id, coalesce(line[len(b)], 0) AS lcs FROM r WHERE i = len(a))"""


@query("F3_lcs_length", B.with_sql("qa", f", {LCS_SQL} SELECT image_id, lcs::BIGINT AS lcs FROM l", True))
def f3(spark, sf):
    return B.qa(spark, sf).select("image_id", long(T.lcs(F.col("pred_words"), F.col("ref_words"))).alias("lcs"))


SHARED = "coalesce(list_sum(list_transform(list_distinct(pred_words), lambda t: least(len(list_filter(pred_words, lambda x: x = t)), len(list_filter(ref_words, lambda x: x = t))))), 0)"
LEX_SQL = f"""lex AS (SELECT image_id, conflict_type, conv_id, np, nr, len(ref_words) > 0 AND pred_words = ref_words AS normalized_exact_match,
 nr > 0 AND contains(' ' || array_to_string(pred_words, ' ') || ' ', ' ' || array_to_string(ref_words, ' ') || ' ') AS reference_contained,
 coalesce(shared / nullif(np, 0), 0) AS token_precision, coalesce(shared / nullif(nr, 0), 0) AS token_recall,
 CASE WHEN shared > 0 THEN 2.0 * shared / (np + nr) ELSE 0 END AS token_f1
 FROM (SELECT *, len(pred_words) AS np, len(ref_words) AS nr, {SHARED}::DOUBLE AS shared FROM qa))"""


def _lexical(spark, sf):
    rows = B.qa(spark, sf)
    return rows.select("image_id", "conflict_type", "conv_id", *[c.alias(n) for n, c in T.lexical(F.col("ref_words"), F.col("pred_words")).items()])


@query(
    "F4_lexical_metrics",
    B.with_sql("qa", f", {LEX_SQL}, {LCS_SQL} SELECT image_id, normalized_exact_match, reference_contained, round(token_precision, 6) AS token_precision, round(token_recall, 6) AS token_recall, round(token_f1, 6) AS token_f1, round(CASE WHEN lcs > 0 THEN 2.0 * lcs / (np + nr) ELSE 0 END, 6) AS rouge_l_f1 FROM lex JOIN l USING (image_id)", True),
)
def f4(spark, sf):
    rows = _lexical(spark, sf)
    return rows.select("image_id", "normalized_exact_match", "reference_contained", *[r6(c).alias(c) for c in ("token_precision", "token_recall", "token_f1", "rouge_l_f1")])


@query("F5_stem", B.with_sql("qa", f"SELECT word, {B.stem_sql('word')} AS stem, count(*) AS n FROM (SELECT unnest(ref_words) AS word FROM qa) GROUP BY word"))
def f5(spark, sf):
    words = B.qa(spark, sf).select(F.explode("ref_words").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.stem(F.col("word")).alias("stem"), "n")


@query("F6_content_tokens", B.with_sql("qa", f"SELECT image_id, array_to_string({B.content_sql('ref_words')}, ' ') AS content FROM qa"))
def f6(spark, sf):
    return B.qa(spark, sf).select("image_id", F.array_join(T.content_tokens(F.col("ref_words")), " ").alias("content"))


def _stance_sql() -> str:
    cases = [("prediction = ''", "'empty'", "'empty_response'", "''", "[]")]
    for name, p in V.ABSTAIN_RULES:
        cases.append((f"regexp_matches(prediction, {_q('(?i)' + p)})", "'abstain_no_visual_input'", _q(name), f"regexp_extract(prediction, {_q('(?i)' + p)}, 0)", "[]"))
    for name, p in V.REJECTION_RULES:
        cases.append((f"regexp_matches(prediction, {_q('(?i)' + p)})", "CASE WHEN len(overlap) > 0 THEN 'reject_premise' ELSE 'ambiguous_rejection' END", _q(name), f"regexp_extract(prediction, {_q('(?i)' + p)}, 0)", "overlap"))
    cases.append(("denied IS NOT NULL", "'reject_premise'", "'target_local_negation'", "array_to_string(stems[greatest(denied - 5, 1):denied + 5], ' ')", "overlap"))
    out = []
    for k, (name, rest) in enumerate((("stance", "'no_explicit_rejection'"), ("stance_rule", "'no_rule_match'"), ("stance_evidence", "''"), ("content_overlap", "overlap"))):
        out.append("CASE " + " ".join(f"WHEN {c[0]} THEN {c[k + 1]}" for c in cases) + f" ELSE {rest} END AS {name}")
    near = f"list_has_any(stems[greatest(i - 8, 1):i + 8], targets) AND coalesce(stems[i + 1], '') NOT IN ({_in(V.NEGATION_EXCLUSIONS)})"
    return f"""st AS (SELECT *, {', '.join(out)} FROM (
 SELECT *, list_filter(range(1, len(stems) + 1), lambda i: stems[i] = 'not' AND {near})[1] AS denied, list_sort(list_intersect(targets, list_distinct(stems))) AS overlap FROM (
 SELECT *, list_transform(pw, lambda w: {B.stem_sql('w')}) AS stems, {B.content_sql('rw')} AS targets FROM (
 SELECT *, {B.tokens_sql('prediction')} AS pw, {B.tokens_sql('reference')} AS rw FROM gen))))"""


STANCE_SQL = _stance_sql()


def _stances(spark, sf):
    rows = T.with_words(B.generations(spark, sf), "reference", "prediction")
    return T.with_stance(rows, "prediction").withColumnRenamed("reference_content_overlap", "content_overlap")


@query("F7_stance", B.with_sql("gen", f", {STANCE_SQL} SELECT image_id, condition, stance, stance_rule, stance_evidence, array_to_string(content_overlap, ' ') AS content_overlap FROM st"))
def f7(spark, sf):
    return _stances(spark, sf).select("image_id", "condition", "stance", "stance_rule", "stance_evidence", F.array_join("content_overlap", " ").alias("content_overlap"))


@query("F8_local_negation", B.with_sql("gen", f", {STANCE_SQL} SELECT image_id, condition, denied - 1 AS place FROM st WHERE denied IS NOT NULL"))
def f8(spark, sf):
    rows = B.generations(spark, sf).select("image_id", "condition", F.transform(T.tokens(F.col("prediction")), T.stem).alias("stems"), T.content_tokens(T.tokens(F.col("reference"))).alias("targets"))
    return rows.select("image_id", "condition", long(T.denied_at(F.col("stems"), F.col("targets"))).alias("place")).where("place IS NOT NULL")


@query("F9_uncertainty", B.with_sql("gen", f"SELECT image_id, condition, regexp_matches(prediction, {_q('(?i)' + V.UNCERTAINTY)}) AS uncertain FROM gen"))
def f9(spark, sf):
    return B.generations(spark, sf).select("image_id", "condition", T.uncertain(F.col("prediction")).alias("uncertain"))


EVAL_SQL = f"""{STANCE_SQL}, ev AS (SELECT image_id, condition, conflict_type, reference, prediction, stance AS raw_stance, stance_rule AS raw_rule, len(content_overlap) AS n_overlap, stance_evidence AS raw_evidence, question,
 em, rc, unsure, condition <> 'multimodal_clean' AS conflict, em OR (rc AND NOT unsure) AS supported,
 CASE WHEN shared > 0 THEN 2.0 * shared / (len(pw) + len(rw)) ELSE 0 END AS token_f1
 FROM (SELECT *, len(rw) > 0 AND pw = rw AS em, len(rw) > 0 AND contains(' ' || array_to_string(pw, ' ') || ' ', ' ' || array_to_string(rw, ' ') || ' ') AS rc,
  regexp_matches(prediction, {_q('(?i)' + V.UNCERTAINTY)}) AS unsure, coalesce(list_sum(list_transform(list_distinct(pw), lambda t: least(len(list_filter(pw, lambda x: x = t)), len(list_filter(rw, lambda x: x = t))))), 0)::DOUBLE AS shared FROM st))"""


def _evaluated(spark, sf):
    return R.scored(B.generations(spark, sf), "reference", "prediction", F.col("condition") != "multimodal_clean")


@query(
    "F10_evaluate_record",
    B.with_sql("gen", f""", {EVAL_SQL} SELECT image_id, condition, round(token_f1, 6) AS token_f1, CASE WHEN conflict THEN raw_stance ELSE 'not_applicable' END AS stance,
 CASE WHEN conflict THEN NULL ELSE unsure END AS prediction_uncertainty_flag, CASE WHEN conflict THEN raw_stance <> 'reject_premise' ELSE NOT supported END AS manual_review_required,
 CASE WHEN conflict THEN CASE WHEN raw_stance = 'reject_premise' THEN '' ELSE 'conflict_stance:' || raw_stance END WHEN supported THEN '' WHEN unsure AND rc THEN 'clean_containment_is_uncertain' ELSE 'clean_answer_requires_semantic_review' END AS manual_review_reason FROM ev"""),
)
def f10(spark, sf):
    return _evaluated(spark, sf).select("image_id", "condition", r6("token_f1").alias("token_f1"), "stance", "prediction_uncertainty_flag", "manual_review_required", "manual_review_reason")


VERDICT_SQL = f"""{EVAL_SQL}, vd AS (SELECT *, CASE WHEN lex OR trusted OR absent THEN 'correct' WHEN raw_stance = 'no_explicit_rejection' THEN 'incorrect' ELSE 'uncertain' END AS verdict,
 CASE WHEN lex THEN 'reference_lexically_supported' WHEN trusted THEN 'target_linked_rejection:' || raw_rule WHEN absent THEN 'target_linked_explicit_absence' WHEN raw_stance = 'no_explicit_rejection' THEN 'no_explicit_false_premise_rejection' ELSE 'non_decisive_stance:' || raw_stance END AS verdict_reason
 FROM (SELECT *, em OR rc OR (regexp_replace(lower(prediction), '[.]+$', '') IN ('0', 'zero') AND regexp_matches(question, {_q('(?i)' + V.COUNT_QUESTION)}) AND regexp_matches(reference, {_q('(?i)' + V.ZERO_REFERENCE)})) AS lex,
 raw_stance = 'reject_premise' AND (raw_rule IN ({_in(V.TRUSTED_REJECTION_RULES)}) OR (raw_rule = 'visual_does_not_contain' AND regexp_matches(raw_evidence, {_q('(?i)' + V.DIRECT_REJECTION)}))) AS trusted,
 n_overlap > 0 AND regexp_matches(prediction, {_q('(?i)' + V.EXTRA_ABSENCE)}) AS absent FROM ev))"""


def _verdicts(spark, sf):
    return R.judged(B.generations(spark, sf), "question", "reference", "prediction")


@query("F11_false_premise_verdict", B.with_sql("gen", f", {VERDICT_SQL} SELECT image_id, condition, verdict, verdict_reason, CASE verdict WHEN 'correct' THEN 1 WHEN 'incorrect' THEN 0 END AS utility FROM vd"))
def f11(spark, sf):
    return _verdicts(spark, sf).select("image_id", "condition", "verdict", "verdict_reason", "utility")



@query("F12_reference_variants", "SELECT conv_id, turn, array_to_string(CASE WHEN len(v) > 0 THEN v ELSE [t] END, '|') AS variants, len(CASE WHEN len(v) > 0 THEN v ELSE [t] END)::BIGINT AS n_variants FROM (SELECT conv_id, turn, t, list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x <> '') AS v FROM (SELECT conv_id, turn, replace(replace(text, ', ', '; '), chr(10), ' ') AS t FROM conversations))")
def f12(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("; ")), F.lit("\n"), F.lit(" "))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", T.variants(text).alias("v")).select("conv_id", "turn", F.array_join("v", "|").alias("variants"), long(F.size("v")).alias("n_variants"))


PAIR_SQL = """pr AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'visual challenge' ELSE 'insufficient context' END AS kind, max(token_f1) FILTER (condition = 'text_only_conflict') - max(token_f1) FILTER (condition = 'multimodal_conflict') AS change,
 bool_or(condition = 'text_only_conflict' AND raw_stance = 'reject_premise') AND NOT bool_or(condition = 'multimodal_conflict' AND raw_stance = 'reject_premise') AS fresh, max(token_f1) FILTER (condition = 'multimodal_conflict') AS similarity FROM ev GROUP BY image_id)"""


def _pairs(spark, sf):
    rows = _evaluated(spark, sf)
    first, second = F.col("condition") == "multimodal_conflict", F.col("condition") == "text_only_conflict"
    rejects = F.col("stance") == "reject_premise"
    kind = F.when(F.col("image_id") % 2 == 0, "visual challenge").otherwise("insufficient context")
    fresh = F.bool_or(second & rejects) & ~F.bool_or(first & rejects)
    agg = rows.groupBy("image_id").agg((F.max(F.when(second, F.col("token_f1"))) - F.max(F.when(first, F.col("token_f1")))).alias("change"), fresh.alias("fresh"), F.max(F.when(first, F.col("token_f1"))).alias("similarity"))
    return agg.withColumn("kind", kind)


@query("F13_audit_candidate", B.with_sql("gen", f", {EVAL_SQL}, {PAIR_SQL} SELECT image_id, round(change, 6) AS change, fresh, (similarity < 0.8) OR abs(change) >= 0.1 OR fresh AS audit_candidate FROM pr"))
def f13(spark, sf):
    return _pairs(spark, sf).select("image_id", r6("change").alias("change"), "fresh", R.audit_candidate(F.col("similarity"), F.col("change"), F.col("fresh")).alias("audit_candidate"))


@query("F14_audit_scope", B.with_sql("gen", f", {EVAL_SQL}, {PAIR_SQL} SELECT image_id, kind FROM pr WHERE (kind = 'visual challenge' AND (abs(change) > 0.1 OR fresh)) OR (kind = 'insufficient context' AND change < -0.1)"))
def f14(spark, sf):
    return _pairs(spark, sf).where(R.audit_scope(F.col("kind"), F.col("change"), F.col("fresh"))).select("image_id", "kind")


def _marks_sql(x: str) -> str:
    out = x
    for mark in V.ANSWER_MARKS:
        beside = f"contains({x}, {_q(mark + ' ')}) OR contains({x}, {_q(' ' + mark)}) OR regexp_matches({x}, '\\d,\\d')"
        out = f"replace({out}, {_q(mark)}, CASE WHEN {beside} THEN '' ELSE ' ' END)"
    # a period goes if no digit follows; a mark of its own keeps neighbours apart
    return f"regexp_replace(regexp_replace({out}, '[.](\\d)', chr(1) || '\\1', 'g'), '[.]', '', 'g')"


def _words_sql(x: str) -> str:
    numbers = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.ANSWER_NUMBERS.items())
    short = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.CONTRACTIONS.items())
    words = f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform(list_filter(list_transform({words}, lambda w: CASE w {numbers} ELSE w END), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: CASE w {short} ELSE w END), ' ')"


@query("F15_answer_marks", f"SELECT DISTINCT p, replace({_marks_sql('p')}, chr(1), '.') AS plain FROM (SELECT o_orderpriority || ' ' || o_orderstatus || ', x' || o_custkey AS p FROM orders UNION ALL SELECT o_orderpriority FROM orders)")
def f15(spark, sf):
    orders = B.table(spark, sf, "orders")
    texts = orders.select(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(", x"), F.col("o_custkey").cast("string")).alias("p")).union(orders.select("o_orderpriority"))
    return texts.distinct().select("p", T.answer_marks(F.col("p")).alias("plain"))


@query("F16_answer_words", f"SELECT c_custkey, {_words_sql('t')} AS words FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'The dont ' WHEN 1 THEN 'none Cant two ' WHEN 2 THEN 'an youre ' ELSE 'oclock A ' END || c_mktsegment AS t FROM customer)")
def f16(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("The dont ", "none Cant two ", "an youre ", "oclock A "))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return B.table(spark, sf, "customer").select("c_custkey", T.answer_words(F.concat(lead, F.col("c_mktsegment"))).alias("words"))


NORMAL_SQL = f"replace({_words_sql(_marks_sql('p'))}, chr(1), '.')"


@query("F17_normalize_answer", f"SELECT DISTINCT o_orderpriority AS answer, {NORMAL_SQL} AS plain FROM (SELECT *, trim(o_orderpriority) AS p FROM orders)")
def f17(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("answer"), T.normalized_answer(F.col("o_orderpriority")).alias("plain"))



@query("F18_official_accuracy", B.with_sql("answers", f"SELECT question_id, round(list_avg(list_transform(range(1, len(g) + 1), lambda i: least(1.0, len(list_filter(range(1, len(g) + 1), lambda j: j <> i AND g[j] = p)) / 3.0))), 6) AS accuracy FROM (SELECT question_id, CASE WHEN d THEN list_transform(answers, lambda p: {NORMAL_SQL}) ELSE answers END AS g, CASE WHEN d THEN {NORMAL_SQL} ELSE p END AS p FROM (SELECT *, len(list_distinct(answers)) > 1 AS d, majority AS p FROM answers))"))
def f18(spark, sf):
    return B.answers(spark, sf).select("question_id", r6(T.official_accuracy(F.col("majority"), F.col("answers"))).alias("accuracy"))


@query("F19_normalized_accuracy", B.with_sql("answers", f"SELECT question_id, round(list_avg(list_transform(range(1, len(g) + 1), lambda i: least(1.0, len(list_filter(range(1, len(g) + 1), lambda j: j <> i AND g[j] = p)) / 3.0))), 6) AS accuracy FROM (SELECT question_id, list_transform(answers, lambda p: {NORMAL_SQL}) AS g, '2 high' AS p FROM answers)"))
def f19(spark, sf):
    return B.answers(spark, sf).select("question_id", r6(T.normalized_accuracy(F.lit("2-High"), F.col("answers"))).alias("accuracy"))


@query("F20_generic_refusal", B.with_sql("gen", f"SELECT condition, regexp_matches(prediction, {_q('(?i)' + V.GENERIC_REFUSAL)}) AS refusal, count(*) AS n FROM gen GROUP BY ALL"))
def f20(spark, sf):
    return B.generations(spark, sf).groupBy("condition", T.generic_refusal(F.col("prediction")).alias("refusal")).agg(F.count(F.lit(1)).alias("n"))


@query("F21_logprob_statistics", B.with_sql("logprobs", 'SELECT id, len("values")::BIGINT AS n, round(list_sum("values"), 6) AS total, round(list_avg("values"), 6) AS mean, round(list_min("values"), 6) AS low, round(list_max("values"), 6) AS high, round(exp(least(80, -list_avg("values"))), 6) AS perplexity FROM logprobs'))
def f21(spark, sf):
    found = A.logprob_statistics(F.col("values"))
    return B.logprobs(spark, sf).select("id", *[long(c).alias(n) if n == "n" else r6(c).alias(n) for n, c in found.items()])


@query("F22_nonzero_statistics", B.with_sql("logprobs", "SELECT id, round(list_sum(v), 6) AS total, round(list_avg(v), 6) AS mean FROM (SELECT id, list_filter(list_transform(\"values\", lambda x: CASE WHEN x > 0 THEN 0 ELSE x END), lambda x: x <> 0) AS v FROM logprobs)"))
def f22(spark, sf):
    clipped = F.transform("values", lambda x: F.when(x > 0, 0.0).otherwise(x))
    return B.logprobs(spark, sf).select("id", *[r6(c).alias(n) for n, c in A.nonzero_statistics(clipped).items()])


VARIANT_SQL = B.with_sql("scores", """, w AS (SELECT image_id, max(score) FILTER (condition = 'view') AS a, max(score) FILTER (condition = 'click') AS b, max(score) FILTER (condition = 'signup') AS c, max(score) FILTER (condition = 'purchase') AS r FROM scores GROUP BY image_id),
d AS (SELECT image_id, [a - r, b - r, c - r] AS x FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND r IS NOT NULL)
SELECT image_id, round(x[1], 6) AS identity, round(list_avg(x), 6) AS mean, round(list_min(x), 6) AS low, round(list_max(x), 6) AS high, round(list_stddev_pop(x), 6) AS std_pop, round(list_max(x) - list_min(x), 6) AS spread,
 round(x[1] - list_min(x), 6) AS worst_drop, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS max_abs, round(len(list_filter(x, lambda v: v > 0)) / 3, 6) AS positive_fraction, round(len(list_filter(x, lambda v: sign(v) = sign(x[1]))) / 3, 6) AS sign_consistency FROM d""")


@query("F23_variant_features", VARIANT_SQL)
def f23(spark, sf):
    from pairscope.operators.align import wide

    rows = wide(B.scores(spark, sf), "image_id", "condition", list(B.SCORE_CONDITIONS), ["score"]).na.drop()
    found = A.variant_features(F.array("score_view", "score_click", "score_signup"), F.col("score_purchase"))
    return rows.select("image_id", *[r6(c).alias(n) for n, c in found.items()])

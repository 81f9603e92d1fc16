"""Whole studies as functions of DataFrames: what a user calls to evaluate an experiment.

Each returns a dictionary of DataFrames: records with their scores, pairs, and summaries in long form. Sinks are the
caller's (``pairscope.sources.io``); ``python -m pairscope`` runs the common ones on files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions import arrays as A
from pairscope.functions import text as T
from pairscope.operators import align as J
from pairscope.operators import contracts as C
from pairscope.operators import review as R
from pairscope.operators import select as M
from pairscope.operators import stats
from pairscope.operators import summarize as S

CONFLICTS = ("multimodal_conflict", "text_only_conflict")
ACTIONS = ("native_prompt", "premise_verification")
SCORES = ("conflict_image", "conflict_text", "clean_image", "clean_text")


def _columns(metrics: dict[str, Column]) -> list[Column]:
    return [m.alias(n) for n, m in metrics.items()]


def evaluate_generations(generations: DataFrame) -> dict[str, DataFrame]:
    """Free generations (image_id, condition, conflict_type, question, reference_answer, generated_text): scored records,
    summaries overall, by condition and type, transitions between the two conflict conditions, and rows to review."""
    C.assert_empty(C.duplicate_keys(generations, ["image_id", "condition"]), "duplicate generations")
    rows = generations.withColumn("reference_first_line", T.first_line(F.col("reference_answer")))
    C.assert_empty(rows.where("reference_first_line IS NULL").select("image_id"), "empty references")
    scored = R.scored(rows, "reference_first_line", "generated_text", F.col("condition").isin(*CONFLICTS))
    metrics = {"n": F.count(F.lit(1))}
    metrics |= {c: F.avg(F.col(c).cast("double")) for c in ("normalized_exact_match", "reference_contained", "token_precision", "token_recall", "token_f1", "rouge_l_f1")}
    metrics |= {s: F.count_if(F.col("stance") == s) for s in ("reject_premise", "ambiguous_rejection", "abstain_no_visual_input", "no_explicit_rejection", "empty")}
    metrics |= {"review_rate": F.avg(F.col("manual_review_required").cast("double"))}
    wide = J.wide(scored, "image_id", "condition", list(CONFLICTS), ["stance"])
    both = wide.where(F.col("stance_multimodal_conflict").isNotNull() & F.col("stance_text_only_conflict").isNotNull())
    cells = S.transitions(F.col("stance_multimodal_conflict") == "reject_premise", F.col("stance_text_only_conflict") == "reject_premise")
    paired = both.agg(*_columns(cells)).withColumn("p_value", stats.exact_two_sided(F.col("first_only"), F.col("second_only")))
    return {"scored": scored, "summary": S.grouped(scored, [[], ["condition"], ["condition", "conflict_type"]], metrics), "transitions": paired, "review": scored.where("manual_review_required")}


def compare_interventions(base: DataFrame, intervention: DataFrame) -> dict[str, DataFrame]:
    """Two scored runs over the same (image_id, condition): transitions of rejection and of containment, with exact tests."""
    keys = ["image_id", "condition"]
    names = ("stance", "reference_contained", "token_f1")
    joined = J.aligned(base.select(*keys, *[F.col(c).alias(f"before_{c}") for c in names]), intervention.select(*keys, *[F.col(c).alias(f"after_{c}") for c in names]), keys)
    rejects = S.transitions(F.col("before_stance") == "reject_premise", F.col("after_stance") == "reject_premise")
    contained = S.transitions(F.col("before_reference_contained"), F.col("after_reference_contained"))
    out = {}
    for name, cells in (("rejection", rejects), ("containment", contained)):
        counts = joined.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *_columns(cells), (F.avg("after_token_f1") - F.avg("before_token_f1")).alias("f1_change"))
        out[name] = counts.withColumn("p_value", stats.exact_two_sided(F.col("first_only"), F.col("second_only")))
    return {"pairs": joined, **out}


def _action_pairs(scored: DataFrame, key: str, values: list[str]) -> DataFrame:
    C.assert_empty(C.duplicate_keys(scored, [key, "action"]), "duplicate actions")
    C.assert_empty(C.incomplete_sets(scored, key, "action", list(ACTIONS)), "incomplete actions")
    return J.wide(scored, key, "action", list(ACTIONS), values)


def evaluate_false_premise(predictions: DataFrame) -> dict[str, DataFrame]:
    """Predictions (haloquest_id, action, question, groundtruth_response, generated_text, image_type): verdicts, paired effects and rates."""
    scored = R.judged(predictions, "question", "groundtruth_response", "generated_text")
    wide = _action_pairs(scored, "haloquest_id", ["utility"])
    pairs = wide.select("haloquest_id", F.col("utility_native_prompt").alias("before"), F.col("utility_premise_verification").alias("after")).withColumn("effect", R.effect_of_utilities(F.col("before"), F.col("after")))
    return {"scored": scored, "pairs": pairs, "actions": S.grouped(scored, [["action"], ["action", "image_type"]], S.verdicts(F.col("verdict"))), "effects": pairs.agg(*_columns(S.effects(F.col("effect"))))}


def evaluate_control(predictions: DataFrame) -> dict[str, DataFrame]:
    """Predictions with several references, parted by semicolons (haloquest_id, action, hallucination_type, groundtruth_response,
    generated_text): the best overlap over references, paired changes, and the rows to audit."""
    words = T.with_stance(T.with_words(predictions, "groundtruth_response", "generated_text"), "generated_text", "__").withColumnsRenamed({"pred_words": "__words", "__stance": "rejection_stance"})
    words = words.withColumn("__variants", T.nfkc_each(T.variants(F.col("groundtruth_response")))).withColumn("__variants", F.transform("__variants", lambda v: T.tokens(v, unicode_form=False)))
    scored = words.select("*", S.best_of(F.col("__variants"), lambda v: T.token_f1(v, F.col("__words"))).alias("best_token_f1"), F.exists("__variants", lambda v: (F.size(v) > 0) & (v == F.col("__words"))).alias("any_exact"))
    scored = scored.drop("ref_words", *[f"__{n}" for n in T.STANCE_FIELDS])
    wide = _action_pairs(scored.withColumn("said", F.array_join("__words", " ")), "haloquest_id", ["best_token_f1", "rejection_stance", "said", "hallucination_type"])
    one, two = (F.split(F.col(f"said_{a}"), " ") for a in ACTIONS)
    rejects = [F.col(f"rejection_stance_{a}") == "reject_premise" for a in ACTIONS]
    pairs = wide.select(
        "haloquest_id", F.col("hallucination_type_native_prompt").alias("hallucination_type"), (F.col("best_token_f1_premise_verification") - F.col("best_token_f1_native_prompt")).alias("lexical_delta"),
        T.token_f1(one, two).alias("response_token_f1"), (rejects[1] & ~rejects[0]).alias("new_target_linked_rejection"),
    )
    pairs = pairs.withColumn("audit_candidate", R.audit_candidate(F.col("response_token_f1"), F.col("lexical_delta"), F.col("new_target_linked_rejection")))
    pairs = pairs.withColumn("in_audit_scope", R.audit_scope(F.col("hallucination_type"), F.col("lexical_delta"), F.col("new_target_linked_rejection")))
    delta = F.col("lexical_delta")
    metrics = {"n": F.count(F.lit(1)), "wins": F.count_if(delta > 0.1), "losses": F.count_if(delta < -0.1), "mean_delta": F.avg(delta), "audit": F.count_if("audit_candidate")}
    return {"scored": scored.drop("__words", "__variants"), "pairs": pairs, "summary": S.grouped(pairs, [[], ["hallucination_type"]], metrics)}


def evaluate_answers(predictions: DataFrame, annotations: DataFrame, epsilon: float = 1e-12) -> dict[str, DataFrame]:
    """Predictions (question_id, action, generated_text) against annotations (question_id, answer_type, answers: array of strings)."""
    C.assert_empty(predictions.join(annotations, "question_id", "left_anti").select("question_id"), "predictions without annotations")
    joined = predictions.join(annotations.select("question_id", "answer_type", "answers"), "question_id")
    said = F.col("generated_text")
    scored = joined.withColumns({"official_accuracy": T.official_accuracy(said, F.col("answers")), "normalized_accuracy": T.normalized_accuracy(said, F.col("answers")), "generic_refusal": T.generic_refusal(said)})
    wide = _action_pairs(scored, "question_id", ["official_accuracy", "normalized_accuracy", "answer_type"])
    before, after = F.col("normalized_accuracy_native_prompt"), F.col("normalized_accuracy_premise_verification")
    pairs = wide.select("question_id", F.col("answer_type_native_prompt").alias("answer_type"), before.alias("before"), after.alias("after"), J.effect(before, after, epsilon).alias("effect"))
    metrics = {"n": F.count(F.lit(1)), "official": F.avg("official_accuracy"), "normalized": F.avg("normalized_accuracy"), "refusals": F.count_if("generic_refusal")}
    return {"scored": scored, "pairs": pairs, "actions": S.grouped(scored, [["action"], ["action", "answer_type"]], metrics), "effects": S.grouped(pairs, [[], ["answer_type"]], S.effects(F.col("effect")))}


def reference_scores(scores: DataFrame, value: str = "candidate_mean_logprob") -> dict[str, DataFrame]:
    """Candidate scores (image_id, condition, conflict_type, candidate_answer, value) under four conditions: visual deltas, sign tests, summaries."""
    C.assert_empty(C.duplicate_keys(scores, ["image_id", "condition"]), "duplicate scores")
    C.assert_empty(C.incomplete_sets(scores, "image_id", "condition", list(SCORES)), "missing score conditions")
    C.assert_empty(C.unequal_values(scores, "image_id", "candidate_answer"), "candidates differ between conditions")
    kinds = scores.where("condition = 'conflict_image'").select("image_id", "conflict_type")
    wide = J.wide(scores, "image_id", "condition", list(SCORES), [value]).join(kinds, "image_id")
    conflict, clean = F.col(f"{value}_conflict_image") - F.col(f"{value}_conflict_text"), F.col(f"{value}_clean_image") - F.col(f"{value}_clean_text")
    pairs = wide.select("image_id", "conflict_type", conflict.alias("conflict_delta"), clean.alias("clean_delta"), (conflict - clean).alias("difference"))
    long = stats.unpivoted(pairs, ["image_id", "conflict_type"], ["conflict_delta", "clean_delta", "difference"])
    metrics = S.signs(F.col("value")) | {n: m for n, m in stats.describe(F.col("value")).items() if n != "n"}
    summary = S.grouped(long, [["feature"], ["feature", "conflict_type"]], metrics).withColumn("p_value", stats.exact_two_sided(F.col("positive"), F.col("negative")))
    return {"pairs": pairs, "summary": summary}


def variant_features(scores: DataFrame, key: str, variants: list[str], text_only: str, value: str) -> DataFrame:
    """Features of score variants (the identity first) against the text-only score, a row per key; sets must be complete."""
    wanted = [*variants, text_only]
    C.assert_empty(C.duplicate_keys(scores, [key, "condition"]), "duplicate scores")
    C.assert_empty(C.incomplete_sets(scores, key, "condition", wanted), "missing score conditions")
    wide = J.wide(scores, key, "condition", wanted, [value])
    found = A.variant_features(F.array(*[F.col(f"{value}_{v}") for v in variants]), F.col(f"{value}_{text_only}"))
    return wide.select(key, *_columns(found))


def feature_analysis(features: DataFrame, key: str, label: str, names: list[str], seed: int = 42, replicates: int = 1000) -> DataFrame:
    """Per feature: class means, AUROC and its stratified bootstrap interval."""
    long = stats.unpivoted(features.select(key, label, *names), [key, label], names)
    area = stats.auroc(long, "value", label, ["feature"])
    drawn = stats.resampled(long, [key], seed, replicates, ["feature", label])
    limits = stats.interval(stats.auroc(drawn, "value", label, ["feature", "replicate"]), "auroc", ["feature"])
    means = long.groupBy("feature").agg(F.avg(F.when(F.col(label), F.col("value"))).alias("mean_positive"), F.avg(F.when(~F.col(label), F.col("value"))).alias("mean_negative"))
    return area.join(means, "feature").join(limits, "feature", "left")


def summarize_semantic_review(review: DataFrame) -> dict[str, DataFrame]:
    """A review (image_id, condition, human_semantic_correct, human_stance, stance): rates without undecided rows, proxy confusion, completeness."""
    rows = review.withColumns({"semantic": R.label("human_semantic_correct"), "how": R.label("human_stance")})
    C.assert_empty(C.broken_rules(rows, R.semantic_rules(F.col("semantic"), F.col("how"), F.col("condition"))).select("image_id", "broken"), "review labels break their rules")
    yes, no = F.col("semantic") == "yes", F.col("semantic") == "no"
    filled = F.when(F.col("condition") == "multimodal_conflict", (F.col("semantic") != "") & (F.col("how") != "")).when(F.col("condition") == "text_only_conflict", F.col("how") != "").otherwise(F.col("semantic") != "")
    metrics = {"n": F.count(F.lit(1)), "yes": F.count_if(yes), "no": F.count_if(no), "rate": S.rate(F.count_if(yes), F.count_if(yes | no)), "complete": F.bool_and(filled)}
    judged = rows.where(F.col("condition").isin(*CONFLICTS) & ~F.col("how").isin("", "n/a"))
    return {"summary": S.grouped(rows, [[], ["condition"]], metrics), "proxy": judged.groupBy("condition").agg(*_columns(S.confusion(F.col("how") == "reject_premise", F.col("stance") == "reject_premise")))}


def validate_selectors(rows: DataFrame, study: M.Study, baseline: str, candidate: str, least: tuple[float, float, float] = (0.03, 0.0, 0.6), replicates: int = 1000) -> dict[str, DataFrame]:
    """Nested cross-validation of feature sets, a group bootstrap of each policy's utility, and the go/no-go decision for candidate over baseline."""
    decisions = M.nested_cv(rows, study)
    joined = decisions.join(rows.select(study.key, study.target, study.before, study.after, study.group), study.key)
    label = F.col(study.target).cast("int") == 1
    per_repeat = joined.groupBy("feature_set", "repeat").agg(*_columns(S.policy(F.col("selected"), F.col(study.before), F.col(study.after))))
    areas = stats.auroc(joined.withColumn("__y", label), "probability", "__y", ["feature_set", "repeat"])
    metrics = per_repeat.join(areas, ["feature_set", "repeat"])
    chosen = M.majority(decisions, study.key).join(rows.select(study.key, study.before, study.after, study.group), study.key)
    gain = F.when(F.col("selected"), F.col(study.after)).otherwise(F.col(study.before)) - F.col(study.after)
    gains = chosen.select("feature_set", study.group, gain.alias("gain"))
    drawn = stats.resampled(gains.select("feature_set", study.group).distinct(), [study.group], study.seed, replicates, ["feature_set"]).join(gains, ["feature_set", study.group])
    limits = stats.interval(drawn.groupBy("feature_set", "replicate").agg(F.avg("gain").alias("gain")), "gain", ["feature_set"])
    a, b = metrics.where(F.col("feature_set") == baseline).select("repeat", F.col("auroc").alias("a0")), metrics.where(F.col("feature_set") == candidate).select("repeat", F.col("auroc").alias("a1"), (F.col("utility") - F.col("utility_after")).alias("policy_gain"))
    decision = a.join(b, "repeat").agg(F.avg(F.col("a1") - F.col("a0")).alias("auroc_gain"), F.avg("policy_gain").alias("policy_gain"), F.avg((F.col("a1") > F.col("a0")).cast("double")).alias("wins"))
    decision = decision.withColumn("decision", M.go_no_go(F.col("auroc_gain"), F.col("policy_gain"), F.col("wins"), *least))
    return {"decisions": decisions, "metrics": metrics, "policy_intervals": limits, "decision": decision}

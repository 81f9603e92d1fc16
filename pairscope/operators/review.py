"""Review labels: resolving, confirming, combining; and evaluation verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.functions import vocabulary as V
from pairscope.operators import contracts as C

# fixed values: the labels' domains
SEMANTIC = ("yes", "no", "uncertain", "n/a")
STANCES = ("reject_premise", "abstain", "answer_premise", "other", "n/a")
CONDITIONS = ("multimodal_conflict", "text_only_conflict", "multimodal_clean")
CONFIRMATIONS = ("accept", "edit")
EFFECTS = ("intervention_helps", "intervention_harms", "semantic_tie", "uncertain")
ACTIONS = ("choose_intervention", "choose_native", "either", "uncertain")
CONFIDENCES = ("high", "medium", "low")


def label(column: str) -> Column:
    """A label stripped and lower-cased; missing reads as blank."""
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def effect_of_labels(before: Column, after: Column) -> Column:
    """The effect of going from one correct-label to another."""
    unsure = (before == "uncertain") | (after == "uncertain")
    return F.when(unsure, "uncertain").when((before == "no") & (after == "yes"), "intervention_helps").when((before == "yes") & (after == "no"), "intervention_harms").otherwise("semantic_tie")


def effect_of_utilities(before: Column, after: Column) -> Column:
    return F.when(before.isNull() | after.isNull(), "uncertain").when(after > before, "helps").when(after < before, "harms").otherwise("tie")


def overall_action(conflict: Column, clean: Column) -> Column:
    """The action to choose: correction on conflicts first, then what happens to clean rows."""
    helps, harms = "intervention_helps", "intervention_harms"
    return (
        F.when((conflict == "uncertain") | (clean == "uncertain") | ((conflict == helps) & (clean == harms)), "uncertain")
        .when(conflict == helps, "choose_intervention")
        .when(conflict == harms, "choose_native")
        .when(clean == helps, "choose_intervention")
        .when(clean == harms, "choose_native")
        .otherwise("either")
    )


def semantic_rules(semantic: Column, how: Column, condition: Column) -> dict[str, Column]:
    """What a semantic review's labels must obey, by condition; blanks are allowed."""
    conflict, text, clean = condition == "multimodal_conflict", condition == "text_only_conflict", condition == "multimodal_clean"
    return {
        "known_semantic": semantic.isin("", *SEMANTIC),
        "known_stance": how.isin("", *STANCES),
        "known_condition": condition.isin(*CONDITIONS),
        "text_only_has_no_semantic": ~text | semantic.isin("", "n/a"),
        "clean_has_no_stance": ~clean | how.isin("", "n/a"),
        "semantic_applies": text | (semantic != "n/a"),
        "stance_applies": clean | (how != "n/a"),
    }


def resolved(ai: Column, human: Column, confirmation: Column) -> Column:
    """The label that holds: the machine's if accepted, the person's if edited, else none."""
    return F.when(confirmation == "accept", ai).when(confirmation == "edit", human)


def confirm(df: DataFrame, rule: Column) -> DataFrame:
    """Accepts the rows of rule that have no confirmation yet; ``changed`` marks them."""
    changed = rule & (label("human_confirmation") == "")
    return df.withColumn("changed", changed).withColumn("human_confirmation", F.when(F.col("changed"), "accept").otherwise(F.col("human_confirmation")))


def confirm_checked(df: DataFrame, rule: Column, note: str, complete: list[str] | None = None) -> DataFrame:
    """As confirm, with a note on the rows that change. A person's edit, an unknown confirmation and an incomplete suggestion within rule are errors."""
    said = label("human_confirmation")
    C.assert_empty(df.where(~said.isin("", *CONFIRMATIONS)), "unknown confirmations")
    C.assert_empty(df.where(rule & (said == "edit")), "an edit would be overwritten")
    for c in complete or []:
        C.assert_empty(df.where(rule & (said == "") & (label(c) == "")), f"incomplete suggestions: {c}")
    done = confirm(df, rule)
    if "human_notes" in df.columns:
        done = done.withColumn("human_notes", F.when(F.col("changed"), note).otherwise(F.col("human_notes")))
    return done


def by_id_sets(key: Column, sets: dict[str, list[int]], default: str) -> Column:
    """The name of the set that holds key, the first one named, else default."""
    out = None
    for name, ids in sets.items():
        out = F.when(key.isin(ids), name) if out is None else out.when(key.isin(ids), name)
    return out.otherwise(default)


def default_note(semantic: Column, how: Column, condition: Column, notes: dict[str, str]) -> Column:
    """The note that a suggestion gets: of notes those for an explicit rejection, another right answer, a wrong one, and clean rows right or wrong."""
    clean = F.when(semantic == "yes", notes["clean_right"]).otherwise(notes["clean_wrong"])
    conflict = F.when((semantic == "yes") & (how == "reject_premise"), notes["rejects"]).when(semantic == "yes", notes["right"]).otherwise(notes["wrong"])
    return F.when(condition == "multimodal_clean", clean).when(condition == "multimodal_conflict", conflict).otherwise("")


def split_decided(df: DataFrame, column: str) -> DataFrame:
    """Rows with a status: kept where the label is yes or no, else excluded with a reason."""
    value = label(column)
    return df.withColumn("status", F.when(value.isin("yes", "no"), "kept").otherwise("excluded")).withColumn("reason", F.when(value == "uncertain", "label is uncertain").when(value == "", "label is missing").when(value.isin("yes", "no"), "").otherwise("label is unknown"))


def scored(df: DataFrame, reference: str, prediction: str, conflict: Column) -> DataFrame:
    """df with the fields of a scored generation: overlap, stance on conflict rows, uncertainty on clean ones, and the
    review it needs. Tokens and stance are made once a row."""
    rows = T.with_stance(T.with_words(df, reference, prediction), prediction, "__")
    fields = _evaluation(F.col(prediction), conflict)
    return rows.select(*df.columns, *[c.alias(n) for n, c in fields.items()])


def judged(df: DataFrame, question: str, reference: str, prediction: str) -> DataFrame:
    """df with verdict (correct, incorrect or uncertain), verdict_reason and utility (1, 0 or NULL)."""
    rows = T.with_stance(T.with_words(df, reference, prediction), prediction, "__")
    fields = _verdict(F.col(question), F.col(reference), F.col(prediction))
    return rows.select(*df.columns, *[c.alias(n) for n, c in fields.items()])


def _stance_columns() -> dict[str, Column]:
    return {n: F.col(f"__{n}") for n in T.STANCE_FIELDS}


def _evaluation(prediction: Column, conflict: Column) -> dict[str, Column]:
    overlap, how = T.lexical(F.col("ref_words"), F.col("pred_words")), _stance_columns()
    unsure = T.uncertain(T.strip(prediction))
    supported = overlap["normalized_exact_match"] | (overlap["reference_contained"] & ~unsure)
    out = dict(overlap)
    for name in ("stance", "stance_rule", "stance_evidence"):
        out[name] = F.when(conflict, how[name]).otherwise("" if name == "stance_evidence" else "not_applicable")
    out["prediction_uncertainty_flag"] = F.when(~conflict, unsure)
    out["manual_review_required"] = F.when(conflict, how["stance"] != "reject_premise").otherwise(~supported)
    clean = F.when(supported, "").when(unsure & overlap["reference_contained"], "clean_containment_is_uncertain").otherwise("clean_answer_requires_semantic_review")
    out["manual_review_reason"] = F.when(conflict, F.when(how["stance"] == "reject_premise", "").otherwise(F.concat(F.lit("conflict_stance:"), how["stance"]))).otherwise(clean)
    return out


def _verdict(question: Column, reference: Column, prediction: Column) -> dict[str, Column]:
    reference, prediction = T.strip(reference), T.strip(prediction)
    overlap, how = T.lexical(F.col("ref_words"), F.col("pred_words")), _stance_columns()
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(prediction), r"(?U)[\s\x1c-\x1f]+", " ")), r"\.+$", "")
    zero = bare.isin("0", "zero") & T.matches(question, V.COUNT_QUESTION) & T.matches(reference, V.ZERO_REFERENCE)
    direct = (how["stance_rule"] == "visual_does_not_contain") & T.matches(how["stance_evidence"], V.DIRECT_REJECTION)
    absent = (F.size(how["reference_content_overlap"]) > 0) & T.matches(prediction, V.EXTRA_ABSENCE)
    supported = overlap["normalized_exact_match"] | overlap["reference_contained"] | zero
    trusted = (how["stance"] == "reject_premise") & (how["stance_rule"].isin(*V.TRUSTED_REJECTION_RULES) | direct)
    silent = how["stance"] == "no_explicit_rejection"
    verdict = F.when(supported | trusted | absent, "correct").when(silent, "incorrect").otherwise("uncertain")
    # fixed values: the reasons' texts
    reason = (
        F.when(supported, "reference_lexically_supported")
        .when(trusted, F.concat(F.lit("target_linked_rejection:"), how["stance_rule"]))
        .when(absent, "target_linked_explicit_absence")
        .when(silent, "no_explicit_false_premise_rejection")
        .otherwise(F.concat(F.lit("non_decisive_stance:"), how["stance"]))
    )
    return {"verdict": verdict, "verdict_reason": reason, "utility": F.when(supported | trusted | absent, 1).when(silent, 0)}


def audit_candidate(similarity: Column, change: Column, new_rejection: Column) -> Column:
    """Rows that a person should see: low similarity, a change of a tenth or more, or a new rejection."""
    return (similarity < 0.8) | (F.abs(change) >= 0.1) | new_rejection


def audit_scope(kind: Column, change: Column, new_rejection: Column) -> Column:
    """The frozen scope: visual challenges with a change of more than a tenth or a new rejection; losses of more than a tenth without context."""
    return ((kind == "visual challenge") & ((F.abs(change) > 0.1) | new_rejection)) | ((kind == "insufficient context") & (change < -0.1))

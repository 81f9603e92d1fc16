"""Review tables from suggestion to summary: confirming, merging, completeness, audits, and what confirmed exclusions change.

A review's label columns come in threes: ai_NAME, human_confirmation (accept, edit or blank), and the edited value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.operators import align as J
from pairscope.operators import contracts as C
from pairscope.operators import review as R
from pairscope.operators import sampling as O
from pairscope.operators import summarize as S

#: The labels of a paired action review.
ACTION_CELLS = ("native_conflict_correct", "intervention_conflict_correct", "native_clean_correct", "intervention_clean_correct")
ACTION_LABELS = (*ACTION_CELLS, "conflict_action_effect", "clean_action_effect", "overall_action", "confidence")
#: Pairs of a semantic review: the final column, the suggestion, the edited value.
SEMANTIC_LABELS = (("human_semantic_correct", "ai_semantic_correct", "human_correction_semantic"), ("human_stance", "ai_stance", "human_correction_stance"))


def confirm_by_confidence(review: DataFrame, confidences: list[str], note: str, complete: list[str] | None = None) -> DataFrame:
    """Accepts the open rows of the named confidences; ``changed`` marks them."""
    wanted = [c.strip().lower() for c in confidences]
    if not wanted or not set(wanted) <= set(R.CONFIDENCES):
        raise C.ContractError(f"unknown confidences: {confidences}")
    return R.confirm_checked(review, R.label("ai_confidence").isin(wanted), note, complete)


def confirm_by_id(review: DataFrame, key: str, ids: list[int], note: str, complete: list[str] | None = None) -> DataFrame:
    """Accepts the open rows of exactly these ids; ids that the review lacks are an error."""
    if not ids:
        raise C.ContractError("no ids to confirm")
    asked = review.sparkSession.createDataFrame([(int(i),) for i in ids], "asked long")  # as many rows as the caller wrote
    held = review.select(F.col(key).cast("long").alias("asked"))
    C.assert_empty(asked.join(held, "asked", "left_anti"), "unknown ids")
    return R.confirm_checked(review, F.col(key).cast("long").isin([int(i) for i in ids]), note, complete)


def merge_confirmed(formal: DataFrame, prereview: DataFrame, keys: list[str]) -> DataFrame:
    """formal with the labels that prereview's confirmed rows resolve to. Rows that formal lacks, labels that differ and edits without a value are errors."""
    said = R.label("human_confirmation")
    confirmed = prereview.where(said.isin(*R.CONFIRMATIONS))
    C.assert_empty(C.duplicate_keys(confirmed, keys), "confirmed twice")
    C.assert_empty(confirmed.join(formal, keys, "left_anti").select(*keys), "confirmed rows that the review lacks")
    found = confirmed.select(*keys, *[R.resolved(R.label(ai), R.label(edit), said).alias(final) for final, ai, edit in SEMANTIC_LABELS])
    finals = [final for final, *_ in SEMANTIC_LABELS]
    C.assert_empty(found.where(S.any_of([F.coalesce(F.col(c), F.lit("")) == "" for c in finals])).select(*keys), "edits without a value")
    blank = formal.withColumns({c: F.when(R.label(c) != "", R.label(c)) for c in finals})
    merged = J.upsert(blank, found, keys, finals)
    return merged.withColumns({c: F.coalesce(c, F.lit("")) for c in finals})


def summarize_action_review(review: DataFrame) -> dict[str, DataFrame]:
    """A paired action review (image_id, ai_* and human_* of ACTION_LABELS, human_confirmation): its status, the suggestions'
    histograms, and, of confirmed rows alone, rates of right answers without undecided ones and histograms."""
    C.assert_empty(C.duplicate_keys(review, ["image_id"]), "reviewed twice")
    said = R.label("human_confirmation")
    C.assert_empty(review.where(~said.isin("", *R.CONFIRMATIONS)).select("image_id"), "unknown confirmations")
    complete = S.all_of([R.label(f"ai_{n}") != "" for n in ACTION_LABELS])
    rows = review.select("image_id", said.alias("confirmation"), complete.alias("ai_complete"), *[R.label(f"ai_{n}").alias(f"ai_{n}") for n in ACTION_LABELS], *[R.resolved(R.label(f"ai_{n}"), R.label(f"human_{n}"), said).alias(n) for n in ACTION_LABELS])
    done = F.count_if(F.col("confirmation") != "")
    status = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("ai_complete").alias("ai_complete"), done.alias("confirmed"), F.when(done == F.count(F.lit(1)), "complete").otherwise("incomplete").alias("status"))
    suggested = _histograms(rows.where("ai_complete"), [f"ai_{n}" for n in ("confidence", "overall_action")])
    confirmed = rows.where("confirmation <> ''")
    cells = confirmed.unpivot(["image_id"], list(ACTION_CELLS), "cell", "label")
    yes, no = F.count_if(F.col("label") == "yes"), F.count_if(F.col("label") == "no")
    rates = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), yes.alias("yes"), no.alias("no"), S.rate(yes, yes + no).alias("rate"))
    return {"status": status, "suggested": suggested, "rates": rates, "confirmed": _histograms(confirmed, list(ACTION_LABELS[4:]))}


def _histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.unpivot(["image_id"], columns, "field", "label").groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"))


def summarize_audit(pairs: DataFrame, audit: DataFrame, in_scope: Column, key: str = "haloquest_id", category: str | None = None) -> dict[str, DataFrame]:
    """An audit (label, key) of the pairs in scope: counts of effects with their balance, the pairs' own effects, and counts by category.

    Ids in several groups, unknown ones, and any difference from the scope are errors."""
    C.assert_empty(C.audit_scope(audit, "label", key, pairs, pairs.where(in_scope)), "the audit doesn't fit its scope")
    joined = audit.select("label", key).distinct().join(pairs, key)
    total = pairs.count()
    helps, harms, tie = (F.count_if(F.col("label") == x) for x in ("helps", "harms", "tie"))
    n = F.count(F.lit(1))
    counts = joined.agg(
        n.alias("n"), (n / F.lit(total)).alias("audited_fraction"), helps.alias("helps"), harms.alias("harms"), tie.alias("tie"), F.count_if(F.col("label") == "uncertain").alias("uncertain"),
        S.rate(helps + harms + tie, n).alias("decisive_coverage"), S.rate(helps, helps + harms).alias("helps_fraction"), S.rate(harms, helps + harms).alias("harms_fraction"), S.rate(helps, harms).alias("helps_per_harm"), (helps - harms).alias("net"),
    )
    out = {"counts": counts}
    if "effect" in pairs.columns:
        out["proxy"] = joined.groupBy("effect").agg(n.alias("n"))
    if "lexical_delta" in pairs.columns:
        delta = F.col("lexical_delta")
        out["direction"] = joined.groupBy(F.when(delta > 0.1, "intervention").when(delta < -0.1, "native").otherwise("tie").alias("direction")).agg(n.alias("n"))
    if category:
        out["by_category"] = joined.groupBy(category, "label").agg(n.alias("n"))
    return out


def confirmed_exclusions(prereview: DataFrame) -> DataFrame:
    """Ids (image_id, note) whose data a person has confirmed to be invalid. Open ones, and ones that don't resolve to uncertain, are errors."""
    rows = prereview.where("condition = 'multimodal_conflict' AND ai_issue_type = 'dataset_validity'")
    said = R.label("human_confirmation")
    C.assert_empty(rows.where(~said.isin(*R.CONFIRMATIONS)).select("image_id"), "validity issues that no one has confirmed")
    label = R.resolved(R.label("ai_semantic_correct"), R.label("human_correction_semantic"), said)
    C.assert_empty(rows.where(F.coalesce(label, F.lit("")) != "uncertain").select("image_id"), "exclusions must resolve to uncertain")
    return rows.select(F.col("image_id").cast("long").alias("image_id"), F.trim(F.coalesce("ai_notes", F.lit(""))).alias("note"))


def validity_sensitivity(prereview: DataFrame, scored: DataFrame, scores: DataFrame, features: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the confirmed exclusions change: the headline of all pairs and of those that stay.

    scored: generations with their stance; scores: reference scores; features: a row per image_id with numbers to rank
    rejections under the multimodal condition by."""
    from pairscope.operators import stats
    from pairscope.plans import studies

    excluded = confirmed_exclusions(prereview)
    if excluded.isEmpty():
        raise C.ContractError("no confirmed exclusions")
    out: dict[str, DataFrame] = {"excluded": excluded}
    heads, areas = [], []
    for variant in ("all", "confirmed"):
        own, own_scores, own_features = (df if df is None or variant == "all" else df.join(excluded, "image_id", "left_anti") for df in (scored, scores, features))
        wide = J.wide(own, "image_id", "condition", list(studies.CONFLICTS), ["stance"]).na.drop()
        rejects = [F.col(f"stance_{c}") == "reject_premise" for c in studies.CONFLICTS]
        cells = S.transitions(*rejects)
        rates = {"n": F.count(F.lit(1)), "multimodal_rate": F.avg(rejects[0].cast("double")), "text_only_rate": F.avg(rejects[1].cast("double"))}
        paired = wide.agg(*[c.alias(n) for n, c in (rates | cells).items()]).withColumn("p_value", stats.exact_two_sided(F.col("first_only"), F.col("second_only")))
        deltas = studies.reference_scores(own_scores)["summary"].where("feature = 'conflict_delta' AND conflict_type = '(all)'")
        picked = deltas.select(F.col("mean").alias("mean_conflict_delta"), F.col("positive").alias("positive_conflict_delta"), F.col("p_value").alias("sign_test_p_value"))
        heads.append(paired.withColumn("variant", F.lit(variant)).join(picked.withColumn("variant", F.lit(variant)), "variant"))
        if own_features is not None:
            names = [c for c in own_features.columns if c != "image_id"]
            long = stats.unpivoted(own_features.join(wide.select("image_id", rejects[0].alias("rejects")), "image_id"), ["image_id", "rejects"], names)
            areas.append(stats.auroc(long, "value", "rejects", ["feature"]).withColumn("variant", F.lit(variant)))
    out["headline"] = heads[0].unionByName(heads[1])
    if areas:
        out["feature_auroc"] = areas[0].unionByName(areas[1])
    return out


def sample_manifest(pairs: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int) -> dict[str, DataFrame]:
    """Nested stratified samples: the rows of the first with flags for the others and an order, and counts per stratum and sample."""
    names = list(sizes)
    flags = O.nested(pairs, key, stratum, sizes, seed)
    manifest = flags.where(names[0]).withColumn("sample_order", O.shuffled_key(seed, F.col(key)))
    counts = flags.groupBy(stratum).agg(F.count(F.lit(1)).alias("population"), *[F.count_if(n).alias(n) for n in names])
    return {"manifest": manifest, "counts": counts}


def control_sample(questions: DataFrame, wanted: dict[str, int], seed: int, least: int = 6, key: str = "question_id") -> dict[str, DataFrame]:
    """Questions (key, image_id, answer_type, answers) whose most frequent normalised answer has at least ``least`` votes: a balanced
    sample by answer type, each image at most once, with its consensus; and counts by answer type."""
    from pairscope.functions import text as T

    plain = F.transform("answers", T.normalized_answer)
    votes = F.transform(F.array_distinct("plain"), lambda a: F.struct(F.size(F.filter("plain", lambda x: x == a)).alias("votes"), a.alias("answer")))
    rows = questions.withColumn("plain", plain).withColumn("__best", F.array_max(F.filter(votes, lambda v: v["answer"] != "")))
    able = rows.where(F.col("__best.votes") >= least).select(*questions.columns, F.col("__best.votes").alias("votes"), F.col("__best.answer").alias("consensus"))
    picked = O.balanced(able, key, "answer_type", "image_id", wanted, seed)
    counts = able.groupBy("answer_type").agg(F.count(F.lit(1)).alias("eligible"), F.count_distinct("image_id").alias("images"))
    taken = picked.groupBy("answer_type").agg(F.count(F.lit(1)).alias("selected"))
    return {"manifest": picked, "counts": counts.join(taken, "answer_type", "left").na.fill(0)}

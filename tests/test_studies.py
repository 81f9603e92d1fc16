"""Whole studies on small fixtures."""

import pytest
from pyspark.sql import functions as F

from pairscope import __main__ as cli
from pairscope.operators import contracts as C
from pairscope.operators import select as M
from pairscope.plans import reviews, studies
from pairscope.sources import io
from pairscope.streaming import scoring
from tests.test_operators import study_rows

BICYCLES = "The image does not contain any bicycles."
GENERATIONS = [
    (image, condition, "object", "Where is the bicycle?", BICYCLES, said)
    for image, first, second in ((1, "no", "no"), (2, "no", "yes"), (3, "yes", "no"), (4, "yes", "yes"))
    for condition, kind in (("multimodal_conflict", first), ("text_only_conflict", second), ("multimodal_clean", "yes"))
    for said in ["There are no bicycles visible in the image." if kind == "no" else "It is near the tree."]
]
SCHEMA = cli.SCHEMAS["generations"]


@pytest.fixture(scope="module")
def generations(spark):
    return spark.createDataFrame(GENERATIONS, SCHEMA)


def test_generations(generations):
    out = studies.evaluate_generations(generations)
    row = out["transitions"].first()
    assert (row.both, row.first_only, row.second_only, row.neither, row.p_value) == (1, 1, 1, 1, 1.0)
    summary = {(r.condition, r.conflict_type): r for r in out["summary"].collect()}
    assert len(summary) == 7 and summary["(all)", "(all)"].n == 12 and summary["multimodal_conflict", "object"].reject_premise == 2
    with pytest.raises(C.ContractError, match="duplicate"):
        studies.evaluate_generations(generations.union(generations))


def test_interventions(spark):
    schema = cli.SCHEMAS["interventions"]
    base = spark.createDataFrame([(1, "c", "no_explicit_rejection", False, 0.2), (2, "c", "reject_premise", True, 0.5)], schema)
    other = spark.createDataFrame([(1, "c", "reject_premise", True, 0.4), (2, "c", "no_explicit_rejection", False, 0.1)], schema)
    row = studies.compare_interventions(base, other)["rejection"].first()
    assert (row.second_only, row.first_only, row.p_value) == (1, 1, 1.0)
    with pytest.raises(C.ContractError, match="not pair-aligned"):
        studies.compare_interventions(base, other.where("image_id = 1"))


def test_false_premise(spark):
    rows = [(1, "native_prompt", "What color is the collar?", "The dog is not wearing a collar.", "The collar is blue.", "real"), (1, "premise_verification", "What color is the collar?", "The dog is not wearing a collar.", "The dog is not wearing a collar.", "real")]
    df = spark.createDataFrame(rows, cli.SCHEMAS["false-premise"])
    out = studies.evaluate_false_premise(df)
    assert out["pairs"].first().effect == "helps" and out["effects"].first().helps_per_harm is None
    with pytest.raises(C.ContractError, match="incomplete"):
        studies.evaluate_false_premise(df.limit(1))


def test_control(spark):
    rows = [(1, "native_prompt", "q", "The ears are gray.; Gray", "Gray", "real", "visual challenge"), (1, "premise_verification", "q", "The ears are gray.; Gray", "The image does not show ears.", "real", "visual challenge")]
    out = studies.evaluate_control(spark.createDataFrame(rows, cli.SCHEMAS["control"]))
    best = {r.action: (r.best_token_f1, r.any_exact) for r in out["scored"].collect()}
    assert best["native_prompt"] == (1.0, True)
    pair = out["pairs"].first()
    assert pair.lexical_delta < 0 and pair.audit_candidate and pair.in_audit_scope


def test_answers(spark):
    predictions = spark.createDataFrame([(1, "native_prompt", "green"), (1, "premise_verification", "The Red.")], cli.SCHEMAS["answers"])
    annotations = spark.createDataFrame([(1, "other", ["red"] * 7 + ["blue"] * 3)], cli.ANNOTATIONS)
    pair = studies.evaluate_answers(predictions, annotations)["pairs"].first()
    assert (pair.before, pair.after, pair.effect) == (0.0, 1.0, "helps")
    with pytest.raises(C.ContractError, match="without annotations"):
        studies.evaluate_answers(predictions, annotations.where("question_id = 2"))


def test_reference_scores(spark):
    values = dict(zip(studies.SCORES, (-1.0, -2.0, -0.5, -1.0), strict=True))
    df = spark.createDataFrame([(1, c, "object", "x", v) for c, v in values.items()], cli.SCHEMAS["reference-scores"])
    row = studies.reference_scores(df)["pairs"].first()
    assert (row.conflict_delta, row.clean_delta, row.difference) == (1.0, 0.5, 0.5)
    with pytest.raises(C.ContractError, match="missing score conditions"):
        studies.reference_scores(df.limit(2))


def test_variant_features_and_analysis(spark):
    rows = [(i, c, v + i / 100) for i in range(4) for c, v in (("identity", -0.2), ("jpeg", -0.5), ("blur", -0.3), ("text", -0.4))]
    found = studies.variant_features(spark.createDataFrame(rows, "id long, condition string, score double"), "id", ["identity", "jpeg", "blur"], "text", "score")
    assert found.first().identity == pytest.approx(0.2)
    table = spark.createDataFrame([(i, i > 1, v) for i, v in enumerate((0.1, 0.2, 0.8, 0.9))], "id long, y boolean, f double")
    row = studies.feature_analysis(table, "id", "y", ["f"], replicates=20).first()
    assert (row.auroc, row.ci_low, row.ci_high, row.valid_resamples) == (1.0, 1.0, 1.0, 20)


def test_semantic_review(spark):
    schema = cli.SCHEMAS["semantic-review"]
    rows = [(1, "multimodal_conflict", "yes", "reject_premise", "reject_premise"), (2, "multimodal_conflict", "no", "answer_premise", "reject_premise"), (3, "multimodal_clean", "", "", "not_applicable")]
    out = studies.summarize_semantic_review(spark.createDataFrame(rows, schema))
    whole = {r.condition: r for r in out["summary"].collect()}
    assert whole["multimodal_conflict"].rate == 0.5 and not whole["multimodal_clean"].complete and whole["multimodal_clean"].rate is None
    assert (out["proxy"].first().tp, out["proxy"].first().fp) == (1, 1)
    with pytest.raises(C.ContractError, match="text_only_has_no_semantic"):
        studies.summarize_semantic_review(spark.createDataFrame([(1, "text_only_conflict", "yes", "other", "x")], schema))


def test_selectors(spark):
    study = M.Study({"weak": ("weak",), "strong": ("strong",)}, group="grp", folds=3, repeats=2, penalties=(0.1, 1.0))
    out = studies.validate_selectors(study_rows(spark), study, "weak", "strong", replicates=10)
    assert out["decision"].first().auroc_gain > 0 and out["policy_intervals"].count() == 2


PREREVIEW = [
    # image_id, condition, ai_semantic_correct, ai_stance, ai_confidence, ai_issue_type, ai_notes, human_confirmation, human_correction_semantic, human_correction_stance, human_notes
    (1, "multimodal_conflict", "yes", "reject_premise", "high", "", "", "", "", "", ""),
    (1, "multimodal_clean", "no", "n/a", "low", "", "", "", "", "", "seen"),
    (2, "multimodal_conflict", "uncertain", "other", "medium", "dataset_validity", "blurred", "accept", "", "", ""),
    (3, "multimodal_conflict", "yes", "other", "medium", "", "", "edit", "no", "answer_premise", ""),
]
PREREVIEW_SCHEMA = "image_id long, " + ", ".join(f"{c} string" for c in "condition ai_semantic_correct ai_stance ai_confidence ai_issue_type ai_notes human_confirmation human_correction_semantic human_correction_stance human_notes".split())


@pytest.fixture(scope="module")
def prereview(spark):
    return spark.createDataFrame(PREREVIEW, PREREVIEW_SCHEMA)


def test_confirmation(spark, prereview):
    done = {(r.image_id, r.condition): (r.human_confirmation, r.human_notes, r.changed) for r in reviews.confirm_by_confidence(prereview, ["High", "low"], "checked").collect()}
    assert done[1, "multimodal_conflict"] == ("accept", "checked", True) and done[1, "multimodal_clean"] == ("accept", "checked", True)
    assert done[2, "multimodal_conflict"] == ("accept", "", False) and done[3, "multimodal_conflict"][0] == "edit"
    with pytest.raises(C.ContractError, match="overwritten"):
        reviews.confirm_by_confidence(prereview, ["medium"], "")
    with pytest.raises(C.ContractError, match="unknown confidences"):
        reviews.confirm_by_confidence(prereview, ["certain"], "")
    assert reviews.confirm_by_id(prereview, "image_id", [1], "x").where("changed").count() == 2
    with pytest.raises(C.ContractError, match="unknown ids"):
        reviews.confirm_by_id(prereview, "image_id", [1, 99], "x")
    with pytest.raises(C.ContractError, match="incomplete"):
        reviews.confirm_by_id(prereview.withColumn("ai_notes", F.lit("")), "image_id", [1], "x", ["ai_notes"])


def test_merging_confirmed_labels(spark, prereview):
    formal = spark.createDataFrame([(i, c, "", "") for i in (1, 2, 3) for c in ("multimodal_conflict", "multimodal_clean")], "image_id long, condition string, human_semantic_correct string, human_stance string")
    merged = {(r.image_id, r.condition): (r.human_semantic_correct, r.human_stance) for r in reviews.merge_confirmed(formal, prereview, ["image_id", "condition"]).collect()}
    assert merged[2, "multimodal_conflict"] == ("uncertain", "other") and merged[3, "multimodal_conflict"] == ("no", "answer_premise")
    assert merged[1, "multimodal_conflict"] == ("", "") and len(merged) == 6
    with pytest.raises(C.ContractError, match="lacks"):
        reviews.merge_confirmed(formal.where("image_id <> 3"), prereview, ["image_id", "condition"])
    with pytest.raises(C.ContractError, match="disagree"):
        reviews.merge_confirmed(formal.withColumn("human_stance", F.lit("abstain")), prereview, ["image_id", "condition"])


def action_rows(spark, confirmations):
    names = reviews.ACTION_LABELS
    ai = ("no", "yes", "yes", "uncertain", "intervention_helps", "semantic_tie", "choose_intervention", "high")
    rows = [(i, *ai, said, *("yes", "yes", "no", "no", "semantic_tie", "semantic_tie", "either", "low")) for i, said in enumerate(confirmations)]
    return spark.createDataFrame(rows, "image_id long, " + ", ".join(f"ai_{n} string" for n in names) + ", human_confirmation string, " + ", ".join(f"human_{n} string" for n in names))


def test_action_review(spark, tmp_path):
    out = reviews.summarize_action_review(action_rows(spark, ["accept", "edit", "accept", ""]))
    status = out["status"].first()
    assert (status.n, status.ai_complete, status.confirmed, status.status) == (4, 4, 3, "incomplete")
    rates = {r.cell: (r.n, r.yes, r.no, r.rate) for r in out["rates"].collect()}
    assert rates["native_conflict_correct"] == (3, 1, 2, 1 / 3) and rates["intervention_clean_correct"] == (3, 0, 1, 0.0)
    assert {(r.field, r.label): r.n for r in out["confirmed"].collect()}["overall_action", "either"] == 1
    path = str(tmp_path / "review")
    io.write_json_lines(action_rows(spark, ["accept", ""]), path)
    with pytest.raises(SystemExit, match="1/2"):
        cli.main(["action-review", "--input", path, "--output", str(tmp_path / "out"), "--require-complete"])
    cli.main(["action-review", "--input", path, "--output", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out/status")).first().status == "incomplete"


def test_audits(spark, tmp_path):
    pairs = spark.createDataFrame([(i, e, d, "a" if i < 3 else "b") for i, (e, d) in enumerate([("helps", 0.5), ("harms", -0.3), ("tie", 0.0), ("helps", 0.2), ("helps", 0.0)])], "haloquest_id long, effect string, lexical_delta double, kind string")
    audit = spark.createDataFrame([(0, "helps"), (1, "helps"), (3, "tie"), (4, "harms")], "haloquest_id long, label string")
    out = reviews.summarize_audit(pairs, audit, F.col("effect") != "tie", category="kind")
    counts = out["counts"].first()
    assert (counts.n, counts.helps, counts.harms, counts.net, counts.audited_fraction, counts.helps_per_harm) == (4, 2, 1, 1, 0.8, 2.0)
    assert {r.direction: r.n for r in out["direction"].collect()} == {"intervention": 2, "native": 1, "tie": 1}
    assert {(r.kind, r.label): r.n for r in out["by_category"].collect()} == {("a", "helps"): 2, ("b", "tie"): 1, ("b", "harms"): 1}
    for wrong, problem in ((audit.limit(3), "missing"), (audit.unionByName(spark.createDataFrame([(0, "tie")], audit.schema)), "several groups"), (audit.unionByName(spark.createDataFrame([(77, "tie")], audit.schema)), "unknown")):
        with pytest.raises(C.ContractError, match=problem):
            reviews.summarize_audit(pairs, wrong, F.col("effect") != "tie")
    io.write_json_lines(pairs, str(tmp_path / "pairs"))
    (tmp_path / "audit.json").write_text('{\n "effect_groups": {"helps": [0, 1],\n "tie": [3], "harms": [4]}\n}')
    cli.main(["audit-summary", "--input", str(tmp_path / "pairs"), "--other", str(tmp_path / "audit.json"), "--output", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out/counts")).first().net == 1


def test_validity_sensitivity(spark, generations, prereview):
    scored = studies.evaluate_generations(generations)["scored"]
    values = {"conflict_image": -1.0, "conflict_text": -2.0, "clean_image": -0.5, "clean_text": -1.0}
    scores = spark.createDataFrame([(i, c, "object", "x", v - i / 10) for i in (1, 2, 3, 4) for c, v in values.items()], cli.SCHEMAS["reference-scores"])
    features = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "image_id long, f double")
    out = reviews.validity_sensitivity(prereview, scored, scores, features)
    heads = {r.variant: r for r in out["headline"].collect()}
    assert (heads["all"].n, heads["confirmed"].n) == (4, 3) and heads["all"].multimodal_rate == 0.5 and heads["confirmed"].positive_conflict_delta == 3
    assert {(r.variant, r.feature): r.auroc for r in out["feature_auroc"].collect()} == {("all", "f"): 0.0, ("confirmed", "f"): 0.0}
    assert [tuple(r) for r in out["excluded"].collect()] == [(2, "blurred")]
    with pytest.raises(C.ContractError, match="no one has confirmed"):
        reviews.confirmed_exclusions(prereview.withColumn("human_confirmation", F.lit("")))


def test_manifests(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(60)], "image_id long, conflict_type string")
    io.write_json_lines(pairs, str(tmp_path / "pairs"))
    cli.main(["sample-manifest", "--input", str(tmp_path / "pairs"), "--output", str(tmp_path / "m"), "--sizes", "baseline=30,audit=9,smoke=3"])
    rows = spark.read.json(str(tmp_path / "m/manifest")).collect()
    assert len(rows) == 30 and sum(r.audit for r in rows) == 9 and sum(r.smoke for r in rows) == 3 and all(r.audit for r in rows if r.smoke)
    questions = spark.createDataFrame([(i, i // 2, "q", "ab"[i % 2], ["Two cats"] * (5 + i % 4) + ["dog"] * 3) for i in range(24)], cli.QUESTIONS)
    out = reviews.control_sample(questions, {"a": 2, "b": 2}, 5)
    picked = out["manifest"].collect()
    assert len(picked) == 4 and len({r.image_id for r in picked}) == 4 and all(r.votes >= 6 and r.consensus == "2 cats" for r in picked)
    assert {r.answer_type: (r.eligible, r.selected) for r in out["counts"].collect()} == {"a": (6, 2), "b": (12, 2)}


def test_selectors_by_command(spark, tmp_path):
    import json

    rows = study_rows(spark).withColumn("answer_type", F.when(F.col("id") % 2 == 0, "number").otherwise("other"))
    io.write_json_lines(rows, str(tmp_path / "rows"))
    io.write_json_lines(rows.withColumn("grp", F.concat("grp", F.lit("x"))), str(tmp_path / "other"))
    settings = {"features": {"weak": ["weak"], "strong": ["strong"]}, "group": "grp", "folds": 3, "repeats": 1, "penalties": [1.0], "baseline": "weak", "candidate": "strong", "replicates": 5, "scope": "scope", "scopes": ["source", "target"]}
    (tmp_path / "study.json").write_text(json.dumps(settings))
    common = ["--study", str(tmp_path / "study.json"), "--input", str(tmp_path / "rows")]
    cli.main(["grouped-selector", *common, "--output", str(tmp_path / "g")])
    assert spark.read.json(str(tmp_path / "g/decision")).first().auroc_gain > 0 and spark.read.json(str(tmp_path / "g/transfer-source-target")).count() == 30
    assert {r.metric for r in spark.read.json(str(tmp_path / "g/comparisons")).collect()} == {"auroc", "mean"}
    cli.main(["frozen-selector", *common, "--other", str(tmp_path / "other"), "--output", str(tmp_path / "f")])
    found = {r.answer_type: r for r in spark.read.json(str(tmp_path / "f/by_stratum")).collect()}
    assert set(found) == {"number", "other"} and all(r.utility_low <= r.utility <= r.utility_high for r in found.values())


def test_command_line_and_stream(spark, generations, tmp_path):
    io.write_json_lines(generations, str(tmp_path / "in"))
    cli.main(["generations", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out/scored")).count() == 12
    for _ in range(2):  # the second run finds nothing new
        scoring.score_folder(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "scored"), str(tmp_path / "checkpoint")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "scored"))
    batch = studies.evaluate_generations(generations)["scored"]
    assert streamed.count() == 12 and streamed.join(batch.select("image_id", "condition", F.col("stance").alias("s")), ["image_id", "condition"]).where("stance <> s").isEmpty()

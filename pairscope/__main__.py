"""Runs studies and review steps on files: ``python -m pairscope COMMAND --input PATH [options] --output FOLDER``.

Inputs are JSON lines, or CSV with a header where the path ends in .csv; each result goes to FOLDER/NAME as JSON lines.
``python -m pairscope COMMAND --help`` lists a command's options."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.operators import align as J
from pairscope.operators import select as M
from pairscope.plans import reviews, studies
from pairscope.sources import io

SCHEMAS = {
    "generations": "image_id long, condition string, conflict_type string, question string, reference_answer string, generated_text string",
    "interventions": "image_id long, condition string, stance string, reference_contained boolean, token_f1 double",
    "false-premise": "haloquest_id long, action string, question string, groundtruth_response string, generated_text string, image_type string",
    "control": "haloquest_id long, action string, question string, groundtruth_response string, generated_text string, image_type string, hallucination_type string",
    "answers": "question_id long, action string, generated_text string",
    "reference-scores": "image_id long, condition string, conflict_type string, candidate_answer string, candidate_mean_logprob double",
    "semantic-review": "image_id long, condition string, human_semantic_correct string, human_stance string, stance string",
}
ANNOTATIONS = "question_id long, answer_type string, answers array<string>"
QUESTIONS = "question_id long, image_id long, question string, answer_type string, answers array<string>"
STUDIES = {
    "generations": studies.evaluate_generations,
    "interventions": studies.compare_interventions,
    "false-premise": studies.evaluate_false_premise,
    "control": studies.evaluate_control,
    "answers": studies.evaluate_answers,
    "reference-scores": studies.reference_scores,
    "semantic-review": studies.summarize_semantic_review,
}
Results = dict[str, DataFrame]


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table from JSON lines, or from CSV as strings."""
    if path.endswith(".csv"):
        return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).na.fill("")
    return spark.read.json(path) if schema is None else io.read_json_lines(spark, path, schema)


def _sizes(text: str) -> dict[str, int]:
    return {name: int(size) for name, size in (part.split("=") for part in text.split(","))}


def _study(path: str) -> tuple[M.Study, dict]:
    """A study from a JSON file: features (name -> columns) and any other field of Study; the rest are the decision's settings."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    known = {k: found.pop(k) for k in list(found) if k in M.Study.__dataclass_fields__}
    known["features"] = {k: tuple(v) for k, v in known["features"].items()}
    if "penalties" in known:
        known["penalties"] = tuple(known["penalties"])
    return M.Study(**known), found


def confirm(spark: SparkSession, args: argparse.Namespace) -> Results:
    review, complete = read(spark, args.input), args.complete.split(",") if args.complete else None
    if args.ids:
        out = reviews.confirm_by_id(review, args.key, [int(i) for i in args.ids.split(",")], args.note, complete)
    else:
        out = reviews.confirm_by_confidence(review, args.confidence.split(","), args.note, complete)
    return {"review": out.drop("changed"), "changed": out.agg(F.count_if("changed").alias("changed"), F.count_if(F.trim("human_confirmation") != "").alias("confirmed"), F.count(F.lit(1)).alias("n"))}


def merge_labels(spark: SparkSession, args: argparse.Namespace) -> Results:
    merged = reviews.merge_confirmed(read(spark, args.input), read(spark, args.other), args.key.split(","))
    return {"review": merged, "complete": merged.agg(F.count_if((F.col("human_semantic_correct") != "") & (F.col("human_stance") != "")).alias("complete"), F.count(F.lit(1)).alias("n"))}


def sample_manifest(spark: SparkSession, args: argparse.Namespace) -> Results:
    return reviews.sample_manifest(read(spark, args.input), args.key, args.stratum, _sizes(args.sizes), args.seed)


def control_sample(spark: SparkSession, args: argparse.Namespace) -> Results:
    return reviews.control_sample(read(spark, args.input, QUESTIONS), _sizes(args.sizes), args.seed, args.least)


def _validated(spark: SparkSession, args: argparse.Namespace) -> Results:
    study, rest = _study(args.study)
    least = tuple(rest.get("least", (0.03, 0.0, 0.6)))
    out = studies.validate_selectors(read(spark, args.input), study, rest["baseline"], rest["candidate"], least, int(rest.get("replicates", 1000)))
    rows = read(spark, args.input).withColumn("__y", F.col(study.target).cast("int") == 1)
    out["comparisons"] = M.compare_sets(out["decisions"], rows, study.key, "__y", study.before, study.after, study.seed, int(rest.get("replicates", 1000)))
    return out


def go_no_go(spark: SparkSession, args: argparse.Namespace) -> Results:
    """Each row is a group of its own, unless the study names one."""
    return _validated(spark, args)


def grouped_selector(spark: SparkSession, args: argparse.Namespace) -> Results:
    """As go-no-go, with the transfer between the scopes of a column, each side's selector frozen without the other's groups."""
    out = _validated(spark, args)
    study, rest = _study(args.study)
    rows = read(spark, args.input)
    if "scope" in rest:
        scopes = rest["scopes"]
        for a, b in (scopes, scopes[::-1]):
            moved = M.transfer(rows.where(F.col(rest["scope"]) == a), rows.where(F.col(rest["scope"]) == b), study, rest["candidate"])
            out[f"transfer-{a}-{b}"] = moved.select(study.key, "probability", "selected")
    return out


def frozen_selector(spark: SparkSession, args: argparse.Namespace) -> Results:
    study, rest = _study(args.study)
    scored = M.transfer(read(spark, args.input), read(spark, args.other), study, rest["candidate"])
    found = M.by_stratum(scored, args.stratum, study.key, study.before, study.after, study.seed, int(rest.get("replicates", 1000)))
    return {"scored": scored.select(study.key, "probability", "selected"), "by_stratum": found}


def audit_summary(spark: SparkSession, args: argparse.Namespace) -> Results:
    """--other: a JSON document with effect_groups, a map of label -> ids."""
    pairs = read(spark, args.input)
    document = spark.read.schema("effect_groups map<string,array<long>>").option("multiLine", True).json(args.other)
    audit = J.exploded_groups(document, "effect_groups").withColumnRenamed("id", args.key)
    return reviews.summarize_audit(pairs, audit, F.expr(args.scope), args.key, args.category)


def action_review(spark: SparkSession, args: argparse.Namespace) -> Results:
    out = reviews.summarize_action_review(read(spark, args.input))
    if args.require_complete and (row := out["status"].first())["status"] != "complete":
        raise SystemExit(f"the review is incomplete: {row['confirmed']}/{row['n']}")
    return out


def validity(spark: SparkSession, args: argparse.Namespace) -> Results:
    features = read(spark, args.features) if args.features else None
    return reviews.validity_sensitivity(read(spark, args.input), read(spark, args.other), read(spark, args.scores, SCHEMAS["reference-scores"]), features)


#: name -> function, and its options beside --input and --output.
Option = tuple[str, dict]
KEY: Option = ("--key", {"default": "image_id"})
SEED: Option = ("--seed", {"type": int, "default": 42})
NEEDED = {"required": True}
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], Results], list[Option]]] = {
    "confirm": (confirm, [KEY, ("--confidence", {"default": "high"}), ("--ids", {}), ("--note", {"default": ""}), ("--complete", {"help": "columns that must be filled"})]),
    "merge-labels": (merge_labels, [("--other", NEEDED), ("--key", {"default": "image_id,condition"})]),
    "sample-manifest": (sample_manifest, [KEY, SEED, ("--stratum", {"default": "conflict_type"}), ("--sizes", NEEDED)]),
    "control-sample": (control_sample, [SEED, ("--sizes", NEEDED), ("--least", {"type": int, "default": 6})]),
    "go-no-go": (go_no_go, [("--study", NEEDED)]),
    "grouped-selector": (grouped_selector, [("--study", NEEDED)]),
    "frozen-selector": (frozen_selector, [("--study", NEEDED), ("--other", NEEDED), ("--stratum", {"default": "answer_type"})]),
    "audit-summary": (audit_summary, [("--other", NEEDED), ("--key", {"default": "haloquest_id"}), ("--scope", {"default": "effect <> 'tie'"}), ("--category", {})]),
    "action-review": (action_review, [("--require-complete", {"action": "store_true"})]),
    "validity-sensitivity": (validity, [("--other", NEEDED), ("--scores", NEEDED), ("--features", {})]),
}


def study(spark: SparkSession, args: argparse.Namespace) -> Results:
    tables = [io.read_json_lines(spark, args.input, SCHEMAS[args.command])]
    if args.command in ("interventions", "answers"):
        tables.append(io.read_json_lines(spark, args.other, ANNOTATIONS if args.command == "answers" else SCHEMAS[args.command]))
    return STUDIES[args.command](*tables)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pairscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in (*STUDIES, *COMMANDS):
        function, options = COMMANDS.get(name, (study, [("--other", NEEDED)] if name in ("interventions", "answers") else []))
        own = commands.add_parser(name, help=(function.__doc__ or STUDIES.get(name, function).__doc__ or "").split("\n")[0])
        for flag, settings in (("--input", NEEDED), ("--output", NEEDED), *options):
            own.add_argument(flag, **settings)
        own.set_defaults(function=function)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pairscope").getOrCreate()
    for name, df in args.function(spark, args).items():
        io.write_json_lines(df, f"{args.output}/{name}")


if __name__ == "__main__":
    main()

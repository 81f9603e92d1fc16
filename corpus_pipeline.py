"""The corpus pipeline: language ID, line deduplication, near copies, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last keep the columns of documents; the last adds ids, n_ids and round_trip. Before a
stage the executors give back the memory that the one before has left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairscope.llm import decontaminate, lang_crf, line_dedup, ngram_join, sentence_pieces
from pairscope.llm.common import drop_path, release, saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _released(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _released(lang_crf.stage)),
    ("line_dedup", _released(line_dedup.stage)),
    ("ngram_jaccard_join", _released(ngram_join.stage)),
    ("decontaminate", _released(decontaminate.stage)),
    ("sentence_pieces", _released(sentence_pieces.stage)),
]

#: No SQL expresses the fitted language stage and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, made = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            drop_path(spark, path)
        path = made
    return docs

"""The subpackage's queries and their SQL; corpus_pipeline adds the pipeline."""

from __future__ import annotations

import corpus_pipeline

from pairscope.llm import catalog


def queries() -> dict:
    return {**catalog.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = dict(catalog.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

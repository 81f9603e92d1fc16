"""The operators' queries over the driver's tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pairscope.llm import chat_format, decontaminate, fingerprints, lang_crf, line_dedup, ngram_join, quality_rules, secret_scan, sentence_pieces, token_output

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_quality_rules": quality_rules.query,
    "op3_sentence_pieces": sentence_pieces.query,
    "op4_lang_crf": lang_crf.query,
    "op5_token_output": token_output.query,
    "op6_line_dedup": line_dedup.query,
    "op7_chat_format": chat_format.query,
    "op8_ngram_join": ngram_join.query,
    "op9_fingerprints": fingerprints.query,
    "op10_decontaminate": decontaminate.query,
}
#: The others fit a model, use a tokenizer or hash in ways that DuckDB lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_chat_format": chat_format.ORACLE_SQL,
    "op8_ngram_join": ngram_join.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}

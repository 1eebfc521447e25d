"""Queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setloom.llm import decontamination, hmm_scoring, html_extraction, line_dedup, merkle, mixing, ngram_jaccard, phrases, quality_rules, sharding, substring_dedup, token_counts, token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_sharding": sharding.op4_sharding,
    "op5_hmm_scoring": hmm_scoring.op5_hmm_scoring,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_token_ids": token_ids.op11_token_ids,
    "op12_phrases": phrases.op12_phrases,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}

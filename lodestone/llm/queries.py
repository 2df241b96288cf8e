"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import conversations, decontamination, lm, mixing, negatives, pieces, quality, sharding, similarity, substrings, tokencounts, tokenfiles, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.query,
    "op2_mixing": mixing.query,
    "op3_decontamination": decontamination.query,
    "op4_toxicity": toxicity.query,
    "op5_token_files": tokenfiles.query,
    "op6_token_counts": tokencounts.query,
    "op7_substrings": substrings.query,
    "op8_quality": quality.query,
    "op9_lm": lm.query,
    "op10_similarity": similarity.query,
    "op11_conversations": conversations.query,
    "op12_pieces": pieces.query,
    "op13_negatives": negatives.query,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op7_substrings": substrings.ORACLE,
    "op8_quality": quality.ORACLE,
    "op10_similarity": similarity.ORACLE,
    "op11_conversations": conversations.ORACLE,
    "op13_negatives": negatives.ORACLE,
}

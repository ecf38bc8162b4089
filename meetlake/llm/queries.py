"""The subpackage's registered queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meetlake.llm import chat_format, exact_dedup, importance, mixing, near_dedup, pii, quality, sentencepiece_bpe, sharding, telephony, token_counts, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_mixing": mixing.query,
    "op3_telephony": telephony.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_sentencepiece": sentencepiece_bpe.query,
    "op7_sharding": sharding.query,
    "op8_chat_format": chat_format.query,
    "op9_near_dedup": near_dedup.query,
    "op10_token_counts": token_counts.query,
    "op11_quality": quality.query,
    "op12_whitening": whitening.query,
    "op13_importance": importance.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_chat_format": chat_format.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op13_importance": importance.SQL,
}

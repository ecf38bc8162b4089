"""The corpus pipeline: toxic documents go, of exact and of near copies one stays, sources are mixed, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again for the next one. All but
the last return the columns of ``docs``, whatever these are.

Null, empty and blank texts pass all stages but for exact de-duplication, of which they are one group; texts are read whole, however long. Repeated rows
fall to one in exact de-duplication. A null doc_id passes where it doesn't stand for a copy. Of an empty table nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meetlake.llm import exact_dedup, mixing, near_dedup, sentencepiece_bpe, toxicity
from meetlake.llm.common import settle, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score says toxic."""
    return toxicity.clean(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.clean(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.clean(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents so that the sources stand in their target shares."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of its tokens, digest of what they decode to, for each row of the mix."""
    return sentencepiece_bpe.query(spark, sf_dir, docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: Learned weights, signatures and merges are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

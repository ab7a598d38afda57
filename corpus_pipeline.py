"""Cleaning a corpus of documents: five stages, each over all that the one before has kept.

`run` writes every stage's result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, decontamination, exact_dedup, language_id, simhash_golay
from textloom.llm.common import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_known(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, checked
    Jaccard similarity of 0.8 or more."""
    return simhash_golay.drop_similar(docs, words=5, similarity=0.8)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.drop_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digests; ``round_trip`` tells whether they give back the text."""
    coded = byte_bpe.encode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "lang", "source", "n_chars")],
        "ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = (
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("simhash_near_dedup", no_near_copies),
    ("benchmark_decontamination", no_benchmark),
    ("byte_bpe", tokens),
)

#: Language identification, fingerprints, alignment and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

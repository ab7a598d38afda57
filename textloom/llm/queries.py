"""The operators of this subpackage as named queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    byte_bpe,
    chunk_dedup,
    decontamination,
    exact_dedup,
    hard_negatives,
    html_templates,
    language_id,
    license_rules,
    merkle,
    simhash_golay,
    suffix_dedup,
    token_files,
    url_templates,
)
from textloom.llm.common import work_folder
from textloom.llm.hard_negatives_sql import HARD_NEGATIVES_SQL
from textloom.llm.merkle_sql import merkle_sql
from textloom.llm.oracle import exact_dedup_sql, license_sql, url_template_sql


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encode(
        _table(spark, folder, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False,
        most_states=300_000)
    return coded.select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge_urls(_table(spark, folder, "pages").select("page_id", "url"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.find_licences(_table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.repeated_passages(_table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_golay.near_groups(_table(spark, folder, "documents"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_templates.extract_main_text(_table(spark, folder, "pages"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(
        hard_negatives.quantised(_table(spark, folder, "embeddings")))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_table(
        _table(spark, folder, "documents"), work_folder(spark, "tokens"),
        public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(_table(spark, folder, "documents"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_byte_bpe, op3_url_filters, op4_exact_dedup, op5_suffix_dedup,
        op6_license_scans, op7_substring_dedup, op8_decontamination, op9_simhash_near_dedup,
        op10_html_extraction, op11_hard_negatives, op12_token_files, op13_merkle_manifest,
    )
}

ORACLE: dict[str, str] = {
    "op3_url_filters": url_template_sql(),
    "op4_exact_dedup": exact_dedup_sql(),
    "op6_license_scans": license_sql(),
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op13_merkle_manifest": merkle_sql(),
}

"""Table schemas, limits and the small fixed dimensions of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Admission and planning limits.
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_PAGES = 400
MAX_TEXT_BYTES = 10 * 1024 * 1024
CHUNK_TOKEN_BUDGET = 1000

# Enumerations.
FORMATS = ("docx", "md", "pdf")
JOB_STATUSES = ("queued", "running", "assembling", "done", "completed_with_errors", "failed")
TERMINAL_STATUSES = ("done", "completed_with_errors", "failed")
CHUNK_STATUSES = ("pending", "inflight", "done")
DOCUMENT_STATUSES = ("uploaded", "analyzing", "extracted", "failed")
OUTCOMES = ("ok", "retryable_error", "fatal_error")
SCRIPTS = ("cyrillic", "latin", "cjk", "arabic")
LITERAL_CATEGORIES = ("placeholder", "date", "currency", "number")

# USD per million tokens as model, input, cached input, output.
PRICES = (
    ("gpt-4o-mini", 0.150, 0.075, 0.600),
    ("gpt-4o", 2.500, 1.250, 10.000),
    ("gpt-6-luna", 0.100, 0.010, 0.500),
    ("gpt-5.6-luna", 0.200, 0.020, 1.200),
)

# Error code, safe message, whether a retry may help.
ERRORS = (
    ("internal_error", "Internal server error", True),
    ("invalid_request", "Request validation failed", False),
    ("not_found", "Requested resource was not found", False),
    ("conflict", "Request conflicts with the resource state", False),
    ("analysis_pending", "Document analysis is pending; retry shortly", True),
    ("unsupported_format", "Document format is unsupported", False),
    ("size_limit", "Document exceeds the 50 MiB upload limit", False),
    ("page_limit", "Document exceeds the 400-page limit", False),
    ("text_limit", "Document exceeds the 10 MiB extracted-text limit", False),
    ("not_ready", "Service dependencies are unavailable", True),
    ("scanned_pdf", "PDF has no usable text layer; OCR is unsupported", False),
    ("corrupt_file", "Document cannot be read or is corrupt", False),
    ("render_failed", "Translated document could not be rendered", False),
    ("cost_cap_exceeded", "Job translation cost limit reached", False),
    ("provider_timeout", "Translation provider timed out", True),
    ("provider_connection", "Translation provider is unreachable", True),
    ("provider_rate_limit", "Translation provider rate limit reached", True),
    ("provider_server_error", "Translation provider is temporarily unavailable", True),
    ("provider_bad_request", "Translation provider rejected the request", False),
    ("provider_auth_error", "Translation provider authorization failed", False),
    ("provider_invalid_response", "Translation provider returned an invalid response", True),
    ("provider_refusal", "Translation provider refused the request", False),
    (
        "shared_dir_unavailable",
        "Shared translation directory is not writable by the service",
        False,
    ),
)

S, I, L, D, TS = "string", "int", "bigint", "double", "timestamp"


def _table(*columns: tuple[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns)


TABLES: dict[str, str] = {
    "documents": _table(
        ("id", S), ("filename", S), ("format", S), ("size_bytes", L), ("page_count", I),
        ("storage_path", S), ("status", S), ("error_code", S), ("created_at", TS),
    ),
    "blocks": _table(
        ("id", S), ("document_id", S), ("seq", I), ("source_text", S), ("source_hash", S),
        ("format_metadata", "variant"),
    ),
    "analyses": _table(
        ("document_id", S), ("source_language", S), ("domain", S), ("register", S),
        ("terms", "array<string>"), ("warnings", "array<string>"), ("triage_status", S),
        ("created_at", TS), ("tokens_in", L), ("tokens_out", L), ("cost_usd", D),
        ("cost_usd_total", D), ("tokens_in_total", L), ("tokens_out_total", L),
    ),
    "jobs": _table(
        ("id", S), ("document_id", S), ("batch_id", S), ("target_language", S), ("status", S),
        ("total_chunks", I), ("done_chunks", I), ("cache_hit_blocks", L),
        ("cache_miss_blocks", L), ("model", S), ("prompt_version", S),
        ("glossary", "map<string,string>"), ("tokens_in", L), ("tokens_out", L),
        ("cost_usd", D), ("error_code", S), ("error_detail", S), ("idempotency_key", S),
        ("lease_owner", S), ("lease_expires_at", TS), ("created_at", TS), ("updated_at", TS),
    ),
    "chunks": _table(
        ("id", S), ("job_id", S), ("seq", I), ("status", S), ("lease_owner", S),
        ("lease_expires_at", TS), ("created_at", TS),
    ),
    "chunk_blocks": _table(("chunk_id", S), ("block_id", S), ("seq_in_chunk", I)),
    "translations": _table(
        ("translation_key", S), ("source_hash", S), ("translated_text", S), ("created_at", TS),
    ),
    "attempts": _table(
        ("id", S), ("chunk_id", S), ("attempt_no", I), ("tokens_in", L), ("tokens_out", L),
        ("cost_usd", D), ("latency_ms", L), ("outcome", S), ("error_detail", S),
        ("created_at", TS),
    ),
}

UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "documents": (("id",),),
    "blocks": (("id",), ("document_id", "seq")),
    "analyses": (("document_id",),),
    "jobs": (("id",), ("idempotency_key",)),
    "chunks": (("id",), ("job_id", "seq")),
    "chunk_blocks": (("chunk_id", "block_id"), ("chunk_id", "seq_in_chunk")),
    "translations": (("translation_key", "source_hash"),),
    "attempts": (("id",),),
}

# Child table and column, parent table and column.
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("blocks", "document_id", "documents", "id"),
    ("analyses", "document_id", "documents", "id"),
    ("jobs", "document_id", "documents", "id"),
    ("chunks", "job_id", "jobs", "id"),
    ("chunk_blocks", "chunk_id", "chunks", "id"),
    ("chunk_blocks", "block_id", "blocks", "id"),
    ("attempts", "chunk_id", "chunks", "id"),
)


def table_schema(name: str) -> T.StructType:
    """Parsed schema of an engine table; needs a running session."""
    return T.StructType.fromDDL(TABLES[name])


def prices(spark: SparkSession) -> DataFrame:
    """Four fixed rows."""
    return spark.createDataFrame(
        list(PRICES), "model string, input double, cached_input double, output double"
    )


def errors(spark: SparkSession) -> DataFrame:
    """The fixed error catalogue."""
    return spark.createDataFrame(
        list(ERRORS), "error_code string, message string, retryable boolean"
    )


def job_statuses(spark: SparkSession) -> DataFrame:
    """Six fixed rows."""
    return spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string")

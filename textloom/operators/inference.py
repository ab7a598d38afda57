"""Batch inference over request tables, with bounded retries and result checks."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import schemas


class ProviderFailure(Exception):
    """A failed call with its catalogue code and the usage that was billed anyway."""

    def __init__(self, code: str, tokens_in: int = 0, tokens_out: int = 0) -> None:
        super().__init__(code)
        self.code, self.tokens_in, self.tokens_out = code, tokens_in, tokens_out


class Provider(Protocol):
    """Translates one request; must be picklable. Returns (text, tokens_in, tokens_out)."""

    def translate(self, text: str, target_language: str, model: str) -> tuple[str, int, int]: ...


class PseudoProvider:
    """Deterministic stand-in: tags the text with its target language."""

    def translate(self, text: str, target_language: str, model: str) -> tuple[str, int, int]:
        result = f"[{target_language}] {text}"
        return result, len(text), len(result)


def pseudo_translation(target_language: Column, source_text: Column) -> Column:
    return F.concat(F.lit("["), target_language, F.lit("] "), source_text)


def pseudo_translate(units: DataFrame) -> DataFrame:
    """The same stand-in without leaving the JVM."""
    return units.withColumn(
        "translated_text", pseudo_translation(F.col("target_language"), F.col("source_text"))
    )


RESULT = (
    "translation_key string, source_hash string, target_language string, model string, "
    "translated_text string, error_code string, attempts array<struct<attempt_no:int,"
    "outcome:string,error_code:string,tokens_in:bigint,tokens_out:bigint,latency_ms:bigint>>"
)


# The first wait and the longest one, in seconds.
BASE_DELAY, LONGEST_DELAY = 0.5, 8.0


def retry_delay(attempt: int, base: float = BASE_DELAY, longest: float = LONGEST_DELAY) -> float:
    """Seconds to wait after the given failed attempt (from 0)."""
    return min(base * 2**attempt + random.uniform(0.0, base), longest)


def infer(
    units: DataFrame,
    provider: Provider,
    max_attempts: int = 3,
    parallelism: int | None = None,
    wait: Callable[[float], None] = time.sleep,
    concurrency: int = 8,
) -> DataFrame:
    """Run every unit through the provider, retrying what the catalogue calls retryable.

    Give it distinct units. Each task has ``concurrency`` calls under way. The result must be written once and read back before it is used
    twice: evaluating the frame again would call the provider again.
    """
    if max_attempts < 1:
        raise ValueError(f"at least one call is needed, not {max_attempts}")
    if concurrency < 1:
        raise ValueError(f"at least one call runs at a time, not {concurrency}")
    retryable = {code: again for code, _, again in schemas.ERRORS}

    def call(text: str, language: str, model: str):
        ledger = []
        for attempt in range(max_attempts):
            started = time.perf_counter()
            failure = None
            try:
                result, used_in, used_out = provider.translate(text, language, model)
                if not isinstance(result, str) or used_in < 0 or used_out < 0:
                    # What was billed counts, whatever the answer is worth.
                    raise ProviderFailure(
                        "provider_invalid_response", max(0, used_in), max(0, used_out))
            except ProviderFailure as error:
                failure, used_in, used_out = error.code, error.tokens_in, error.tokens_out
            except Exception:
                failure, used_in, used_out = "provider_connection", 0, 0
            again = retryable.get(failure, True)
            ledger.append(
                {
                    "attempt_no": attempt + 1,
                    "outcome": "ok" if failure is None
                    else "retryable_error" if again else "fatal_error",
                    "error_code": failure,
                    "tokens_in": max(0, used_in),
                    "tokens_out": max(0, used_out),
                    "latency_ms": max(0, round((time.perf_counter() - started) * 1000)),
                }
            )
            if failure is None:
                return result, None, ledger
            if not again or attempt + 1 == max_attempts:
                return None, failure, ledger
            wait(retry_delay(attempt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Calls wait for an answer most of their time, so some run at once; answers are passed on
        # once a second, not only when a whole batch is done.
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                texts, languages, models = (
                    batch[c].tolist() for c in ("source_text", "target_language", "model"))
                answers, start, due = [], 0, time.monotonic() + 1
                for first in range(0, len(batch), 4 * concurrency):
                    part = slice(first, first + 4 * concurrency)
                    answers += pool.map(call, texts[part], languages[part], models[part])
                    if time.monotonic() < due and start + len(answers) < len(batch):
                        continue
                    yield batch.iloc[start:start + len(answers)][
                        ["translation_key", "source_hash", "target_language", "model"]
                    ].assign(
                        translated_text=[a[0] for a in answers],
                        error_code=[a[1] for a in answers],
                        attempts=[a[2] for a in answers],
                    )
                    answers, start, due = [], start + len(answers), time.monotonic() + 1

    picked = units.select(
        "translation_key", "source_hash", "source_text", "target_language", "model"
    )
    if parallelism is not None:
        picked = picked.repartition(parallelism, "translation_key", "source_hash")
    return picked.mapInPandas(run, RESULT)


def infer_to_table(units: DataFrame, provider: Provider, path: str, **options) -> DataFrame:
    """Infer once, write the results and read them back."""
    infer(units, provider, **options).write.mode("append").parquet(path)
    return units.sparkSession.read.schema(RESULT).parquet(path)


class ChunkProvider(Protocol):
    """Translates the blocks of one chunk; must be picklable.

    A request has target_language, model, plan, glossary, context_before, blocks_to_translate and
    context_after; blocks have seq, block_id and source_text. Returns (texts by block id, tokens in,
    tokens out) of the call.
    """

    def translate_chunk(self, request: dict) -> tuple[dict[str, str], int, int]: ...


class PseudoChunkProvider:
    """Deterministic stand-in for whole chunks."""

    def translate_chunk(self, request: dict) -> tuple[dict[str, str], int, int]:
        tag = request["target_language"]
        told = {b["block_id"]: f"[{tag}] {b['source_text']}"
                for b in request["blocks_to_translate"]}
        return told, len(str(request)), sum(map(len, told.values()))


CHUNK_RESULT = (
    "document_id string, chunk_seq bigint, target_language string, model string, "
    "error_code string, blocks array<struct<block_id:string,translated_text:string>>, "
    "attempts array<struct<attempt_no:int,outcome:string,error_code:string,tokens_in:bigint,"
    "tokens_out:bigint,latency_ms:bigint>>"
)


def infer_chunks(
    requests: DataFrame,
    provider: ChunkProvider,
    wait: Callable[[float], None] = time.sleep,
    concurrency: int = 8,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Run every request of ``planning.build_requests`` through a chunk provider.

    ``requests`` has in addition model and attempts_left, the calls that the chunk may still make.
    An answer must hold exactly the blocks asked for, as texts; another one is retried as an invalid
    response, and what it was billed counts. Write the result before using it twice. ``keep`` names
    columns of the requests that stand beside their results.
    """
    retryable = {code: again for code, _, again in schemas.ERRORS}

    def one(row) -> tuple:
        request = {
            "target_language": row.target_language, "model": row.model,
            "plan": json.loads(row.plan_json), "glossary": json.loads(row.glossary_json),
            **json.loads(row.payload_json),
        }
        asked = {b["block_id"] for b in request["blocks_to_translate"]}
        ledger, failure, told = [], "attempts_exhausted", {}
        for attempt in range(row.attempts_left):
            started, failure, used_in, used_out = time.perf_counter(), None, 0, 0
            try:
                told, used_in, used_out = provider.translate_chunk(request)
                if set(told) != asked or not all(isinstance(t, str) for t in told.values()) or (
                    min(used_in, used_out) < 0
                ):
                    failure = "provider_invalid_response"
            except ProviderFailure as error:
                failure, used_in, used_out = error.code, error.tokens_in, error.tokens_out
            except Exception:
                failure = "provider_connection"
            again = failure is not None and retryable.get(failure, True)
            ledger.append({
                "attempt_no": attempt + 1, "error_code": failure,
                "outcome": "ok" if failure is None
                else "retryable_error" if again else "fatal_error",
                "tokens_in": max(0, used_in), "tokens_out": max(0, used_out),
                "latency_ms": round((time.perf_counter() - started) * 1000),
            })
            if not again:
                break
            if attempt + 1 < row.attempts_left:
                wait(retry_delay(attempt))
        blocks = [] if failure else [
            {"block_id": k, "translated_text": v} for k, v in told.items()]
        return failure, blocks, ledger

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for first in range(0, len(batch), 4 * concurrency):
                    part = batch.iloc[first:first + 4 * concurrency]
                    answers = list(pool.map(one, part.itertuples(index=False)))
                    yield part[
                        ["document_id", "chunk_seq", "target_language", "model", *keep]
                    ].assign(
                        error_code=[a[0] for a in answers], blocks=[a[1] for a in answers],
                        attempts=[a[2] for a in answers])

    kept = "".join(f", `{c}` {requests.schema[c].dataType.simpleString()}" for c in keep)
    return requests.select(
        "document_id", "chunk_seq", "target_language", "model", "plan_json", "glossary_json",
        "payload_json", F.col("attempts_left").cast("int").alias("attempts_left"), *keep,
    ).mapInPandas(run, CHUNK_RESULT + kept)


def attempt_ledger(results: DataFrame) -> DataFrame:
    """Every call that was made, one row each."""
    return results.select(
        "translation_key", "source_hash", "model", F.inline("attempts")
    )


def validate_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Verdict per chunk: exactly one result per requested block and nothing else.

    ``requests``: chunk_id, block_id, model. ``results``: chunk_id, block_id, model,
    translated_text, tokens_in, tokens_out.
    """
    wanted = requests.groupBy("chunk_id", "block_id").agg(F.min("model").alias("_model"))
    given = results.groupBy("chunk_id", "block_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("model").alias("_lo"), F.max("model").alias("_hi"),
        F.bool_or(F.col("translated_text").isNull()).alias("_untold"),
        F.bool_or(
            F.coalesce(F.col("tokens_in"), F.lit(-1)).__lt__(0)
            | F.coalesce(F.col("tokens_out"), F.lit(-1)).__lt__(0)
        ).alias("_bad_usage"),
    )
    pairs = wanted.join(given, ["chunk_id", "block_id"], "full_outer")
    asked, told = F.col("_model").isNotNull(), F.col("_n").isNotNull()
    wrong_model = asked & told & ((F.col("_lo") != F.col("_model")) |
                                  (F.col("_hi") != F.col("_model")))
    counts = pairs.groupBy("chunk_id").agg(
        F.count_if(asked & ~told).alias("missing"),
        F.count_if(told & ~asked).alias("extra"),
        F.count_if(F.col("_n") > 1).alias("duplicated"),
        F.count_if(wrong_model).alias("wrong_model"),
        F.count_if(F.col("_bad_usage")).alias("bad_usage"),
        F.count_if(F.col("_untold")).alias("no_text"),
    )
    bad = sum(
        (F.col(c) for c in ("extra", "duplicated", "wrong_model", "bad_usage", "no_text")),
        F.col("missing"),
    )
    return counts.select(
        "*", F.when(bad > 0, "provider_invalid_response").alias("error_code")
    )


def classify_error(df: DataFrame, column: str = "error_code") -> DataFrame:
    """Safe message and retry flag; unknown codes count as internal errors, null as none."""
    listed = schemas.errors(df.sparkSession).select(
        F.col("error_code").alias("_code"), "message", "retryable"
    )
    known = [code for code, _, _ in schemas.ERRORS]
    safe = F.when(F.col(column).isin(known), F.col(column)).when(
        F.col(column).isNotNull(), "internal_error"
    )
    # The catalogue is a fixed list of 23 rows.
    return (
        df.withColumn("safe_code", safe)
        .join(F.broadcast(listed), F.col("safe_code") == F.col("_code"), "left")
        .drop("_code")
    )


def clean_usage(df: DataFrame, columns: Sequence[str] = ("tokens_in", "tokens_out")) -> DataFrame:
    """Missing or negative usage counts as none."""
    return df.withColumns(
        {c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint") for c in columns}
    )


def attempt_outcome(df: DataFrame, column: str = "error_code") -> DataFrame:
    """ok, retryable_error or fatal_error from the error code."""
    outcome = (
        F.when(F.col("safe_code").isNull(), "ok")
        .when(F.col("retryable"), "retryable_error")
        .otherwise("fatal_error")
    )
    return classify_error(df, column).withColumn("outcome", outcome)

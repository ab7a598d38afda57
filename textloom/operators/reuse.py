"""Content-addressed reuse: lookups in, and appends to, the translation memory."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ordered import earliest, previous_value

KEY = ["translation_key", "source_hash"]


def lookup(blocks: DataFrame, memory: DataFrame) -> DataFrame:
    """Blocks with their stored translation, null when there is none.

    The memory has one row per key; a hash shared by very many blocks makes one large
    partition on the block side only, which adaptive execution splits.
    """
    return blocks.join(memory.select(*KEY, "translated_text"), KEY, "left")


def misses(blocks: DataFrame, memory: DataFrame) -> DataFrame:
    return blocks.join(memory.select(*KEY), KEY, "left_anti")


def distinct_units(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Texts to infer, each once. Repeats collapse map-side before the shuffle.

    ``keep`` names further columns that the key determines.
    """
    return blocks.groupBy(*KEY, *keep).agg(
        F.min("source_text").alias("source_text"), F.count(F.lit(1)).alias("blocks")
    )


def new_units(blocks: DataFrame, memory: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct texts the memory lacks.

    Repeats go first and the anti-join second: a text that fills a third of the corpus then
    enters the join as one row.
    """
    return distinct_units(blocks, keep).join(memory.select(*KEY), KEY, "left_anti")


def hit_miss_counts(blocks: DataFrame, memory: DataFrame, job: list[str]) -> DataFrame:
    """Hits and misses per job, counted per block, repeats included.

    Blocks are first counted per (job, text), so the join sees each text once per job.
    """
    counted = blocks.groupBy(*job, *KEY).agg(F.count(F.lit(1)).alias("_n"))
    marked = counted.join(memory.select(*KEY, F.lit(True).alias("_hit")), KEY, "left")
    return marked.groupBy(*job).agg(
        F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("_hit"), 0).otherwise(F.col("_n"))).alias("misses"),
    )


def append_first_wins(new: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows to append: first of each new key, keys already stored left alone.

    There is no insertion order in a table, so the winner is the smallest
    (created_at, translated_text).
    """
    first = earliest(new, KEY, [F.col("created_at"), F.col("translated_text")])
    return first.join(memory.select(*KEY), KEY, "left_anti")


def hit_ratio(hits: Column, total_misses: Column) -> Column:
    """Whole percent, halves up; null before any lookup."""
    total = hits + total_misses
    return F.when(total > 0, F.floor(100 * hits / total + 0.5).cast("bigint"))


def hit_ratio_between_snapshots(
    snapshots: DataFrame, keys: list[str], order: Column, bucket: Column
) -> DataFrame:
    """Share of hits among the lookups between consecutive snapshots of each series."""
    pair = F.struct("hits", "misses")
    with_last = previous_value(snapshots, keys, [order], pair, bucket, "last")
    hits = F.col("hits") - F.col("last.hits")
    total = hits + F.col("misses") - F.col("last.misses")
    return with_last.withColumn("ratio", F.when(total > 0, hits / total)).drop("last")


def check_raised_cap(raised: float, default_cap: float) -> float:
    """A raised cap must be a finite positive number above the default."""
    number = isinstance(raised, int | float) and not isinstance(raised, bool)
    if not number or not math.isfinite(raised) or raised <= 0 or raised <= default_cap:
        raise ValueError("raised cap must be finite, positive and above the default cap")
    return float(raised)


def retry_plan(
    jobs: DataFrame,
    chunks: DataFrame,
    chunk_units: DataFrame,
    memory: DataFrame,
    attempts: DataFrame,
    now: Column,
    raised_cap: float | None = None,
    default_cap: float = 5.0,
) -> DataFrame:
    """New chunk states for failed and partly failed jobs that no worker holds.

    ``chunk_units`` has chunk_id and the KEY columns of the chunk's blocks. A chunk is done
    when every block is in the memory, otherwise pending with its highest attempt number as
    the baseline. With ``raised_cap`` only jobs that cost less than it qualify.
    """
    retryable = F.col("status").isin("failed", "completed_with_errors")
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    chosen = jobs.where(retryable & free)
    if raised_cap is not None:
        chosen = chosen.where(F.col("cost_usd") < check_raised_cap(raised_cap, default_cap))
    held = chunks.where((F.col("status") == "inflight") & (F.col("lease_expires_at") > now))
    chosen = chosen.select(F.col("id").alias("job_id")).join(
        held.select("job_id"), "job_id", "left_anti"
    )
    work = chunks.join(chosen, "job_id", "left_semi").select(
        F.col("id").alias("chunk_id"), "job_id", "seq"
    )
    open_chunks = (
        chunk_units.select("chunk_id", *KEY)
        .join(memory.select(*KEY), KEY, "left_anti")
        .groupBy("chunk_id").agg(F.lit(True).alias("_open"))
    )
    baselines = attempts.groupBy("chunk_id").agg(F.max("attempt_no").alias("_top"))
    pending = F.coalesce(F.col("_open"), F.lit(False))
    return (
        work.join(open_chunks, "chunk_id", "left")
        .join(baselines, "chunk_id", "left")
        .select(
            "job_id", "chunk_id", "seq",
            F.when(pending, "pending").otherwise("done").alias("status"),
            F.when(pending, F.coalesce("_top", F.lit(0))).cast("bigint").alias("baseline"),
        )
    )


def retry_progress(plan: DataFrame) -> DataFrame:
    """Queued job state after a retry: recomputed done count."""
    return plan.groupBy("job_id").agg(
        F.lit("queued").alias("status"), F.count_if(F.col("status") == "done").alias("done_chunks"),
        F.count(F.lit(1)).alias("total_chunks"),
    )


def reuse_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks of an edited document whose text the earlier version already had."""
    known = before.select("document_id", "source_hash").distinct().withColumn(
        "_known", F.lit(True)
    )
    marked = after.join(known, ["document_id", "source_hash"], "left")
    return marked.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("_known").alias("reused"),
    ).withColumn("reused_share", F.col("reused") / F.col("blocks"))

"""Operational state derived from the job tables, and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import schemas



def metrics_snapshot(jobs: DataFrame, attempts: DataFrame, analyses: DataFrame) -> DataFrame:
    """(metric, label, value): every job status, costs, errors, cache and analysis counters.

    Each table is aggregated once; only single rows are put together.
    """
    statuses = schemas.job_statuses(jobs.sparkSession)
    counted = jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("usd"),
        F.sum("cache_hit_blocks").alias("hits"), F.sum("cache_miss_blocks").alias("misses"),
    )
    by_status = statuses.join(counted, "status", "left").select(
        F.lit("jobs_by_status").alias("metric"), F.col("status").alias("label"),
        F.coalesce("n", F.lit(0)).cast("double").alias("value"),
    )
    totals = counted.agg(*[F.sum(c).alias(c) for c in ("usd", "hits", "misses")])
    failed = attempts.agg(F.count_if(F.col("outcome") != "ok").alias("errors"))
    triage = analyses.agg(
        F.sum("cost_usd_total").alias("triage_usd"),
        F.sum("tokens_in_total").alias("triage_in"), F.sum("tokens_out_total").alias("triage_out"),
    )

    def long_form(frame: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
        entries = F.array(*[
            F.struct(
                F.lit(metric).alias("metric"), F.lit(label).alias("label"),
                F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value"),
            )
            for column, (metric, label) in names.items()
        ])
        return frame.select(F.inline(entries))

    return (
        by_status
        .unionByName(long_form(totals, {
            "usd": ("llm_cost_usd_total", ""), "hits": ("cache_hits_total", ""),
            "misses": ("cache_misses_total", ""),
        }))
        .unionByName(long_form(failed, {"errors": ("llm_errors_total", "")}))
        .unionByName(long_form(triage, {
            "triage_usd": ("llm_triage_cost_usd_total", ""),
            "triage_in": ("llm_triage_tokens_total", "input"),
            "triage_out": ("llm_triage_tokens_total", "output"),
        }))
    )


def recent_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` newest jobs, ties by id."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a whole number above zero")
    return jobs.orderBy(F.desc("created_at"), F.asc("id")).limit(limit)


def jobs_by_batch(jobs: DataFrame, batch_id: str) -> DataFrame:
    return jobs.where(F.col("batch_id") == batch_id).orderBy("created_at", "id")


def batch_family(jobs: DataFrame, digest: str) -> DataFrame:
    """Jobs of every batch of one request digest, oldest first."""
    return jobs.where(F.col("batch_id").startswith(f"{digest}.")).orderBy("created_at", "id")


def filter_by_status(jobs: DataFrame, status: str = "all") -> DataFrame:
    return jobs if status == "all" else jobs.where(F.col("status") == status)


def order_by_request(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs of each request (batch_id, languages) with the position their language was
    asked for; languages without a job are left out."""
    asked = requests.select("batch_id", F.posexplode("languages").alias("position",
                                                                     "target_language"))
    return jobs.join(asked, ["batch_id", "target_language"])


def pending_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("status") == "pending").orderBy("job_id", "seq", "id")


def unfinished_count(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    left = chunks.groupBy("job_id").agg(F.count_if(F.col("status") != "done").alias("unfinished"))
    return jobs.select(F.col("id").alias("job_id")).join(left, "job_id", "left").select(
        "job_id", F.coalesce("unfinished", F.lit(0)).alias("unfinished")
    )


def apply_progress(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress never falls, never exceeds the total, and moves active jobs only."""
    best = progress.groupBy("job_id").agg(F.max("done_chunks").alias("_new"))
    active = F.col("status").isin("running", "assembling") & F.col("_new").isNotNull()
    moved = F.least("total_chunks", F.greatest("done_chunks", F.col("_new").cast("int")))
    return (
        jobs.join(best.withColumnRenamed("job_id", "id"), "id", "left")
        .withColumn("done_chunks", F.when(active, moved).otherwise(F.col("done_chunks")))
        .drop("_new")
    )


def stale_grace_seconds(lease_seconds: int) -> int:
    return max(120, 2 * lease_seconds)


def _seconds_before(moment: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) - seconds * 1_000_000)


def stale_inflight(chunks: DataFrame, now: Column, lease_seconds: int = 60) -> DataFrame:
    """Inflight chunks whose lease ran out strictly before now minus the grace period."""
    cutoff = _seconds_before(now, stale_grace_seconds(lease_seconds))
    return chunks.where((F.col("status") == "inflight") & (F.col("lease_expires_at") < cutoff))


def _expired(now: Column) -> Column:
    lease = F.col("lease_expires_at")
    return lease.isNull() | (lease <= now)


def release_expired(chunks: DataFrame, now: Column) -> DataFrame:
    """All chunks after the release, with ``released`` marking the changed ones."""
    gone = (F.col("status") == "inflight") & _expired(now)
    return chunks.withColumn("released", gone).withColumns(
        {
            "status": F.when(F.col("released"), "pending").otherwise(F.col("status")),
            "lease_expires_at": F.when(~F.col("released"), F.col("lease_expires_at")),
        }
    )


def eligible_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimable jobs; order by created_at, id to take the next one."""
    return jobs.where(F.col("status").isin("queued", "running", "assembling") & _expired(now))


def eligible_chunks(chunks: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """The next claimable chunk of every running job: lowest seq, then id."""
    open_chunks = chunks.where((F.col("status") == "pending") & _expired(now))
    running = jobs.where(F.col("status") == "running").select(F.col("id").alias("job_id"))
    return (
        open_chunks.join(running, "job_id", "left_semi")
        .groupBy("job_id")
        .agg(F.min_by(F.struct("id", "seq"), F.struct("seq", "id")).alias("c"))
        .select("job_id", F.col("c.id").alias("chunk_id"), F.col("c.seq").alias("seq"))
    )


def analysis_backlog(docs: DataFrame, analyses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents that still need an analysis and have no jobs yet."""
    analysed = analyses.where(F.col("triage_status") == "ok").select(F.col("document_id").alias("id"))
    used = jobs.select(F.col("document_id").alias("id"))
    waiting = docs.where(F.col("status").isin("uploaded", "analyzing", "extracted"))
    return waiting.join(analysed, "id", "left_anti").join(used, "id", "left_anti")


def documents_in_use(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    return docs.join(jobs.select(F.col("document_id").alias("id")), "id", "left_semi")


def repair_stuck_status(docs: DataFrame, analyses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents left analyzing although their analysis is final become extracted."""
    known = analyses.groupBy(F.col("document_id").alias("id")).agg(
        F.bool_or(F.col("triage_status") == "ok").alias("_ok")
    )
    frozen = jobs.groupBy(F.col("document_id").alias("id")).agg(F.lit(True).alias("_used"))
    final = F.col("_ok") | (F.col("_ok").isNotNull() & F.coalesce("_used", F.lit(False)))
    stuck = (F.col("status") == "analyzing") & F.coalesce(final, F.lit(False))
    return (
        docs.join(known, "id", "left").join(frozen, "id", "left")
        .withColumn("repaired", stuck)
        .withColumn("status", F.when(F.col("repaired"), "extracted").otherwise(F.col("status")))
        .drop("_ok", "_used")
    )


def discard_degraded(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    """Analyses without the degraded ones of the given documents."""
    named = ids.select("document_id").distinct().withColumn("_named", F.lit(True))
    drop = F.coalesce("_named", F.lit(False)) & (F.col("triage_status") == "degraded")
    return analyses.join(named, "document_id", "left").where(~drop).drop("_named")


def final_status(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """done when every block is translated or passed through and none is degraded.

    ``outcomes``: job_id, translated, passthrough, degraded per block.
    """
    fine = (F.col("translated") | F.col("passthrough")) & ~F.col("degraded")
    verdict = outcomes.groupBy("job_id").agg(F.bool_and(fine).alias("_fine"))
    return jobs.select(F.col("id").alias("job_id")).join(verdict, "job_id", "left").select(
        "job_id",
        F.when(F.coalesce("_fine", F.lit(True)), "done").otherwise("completed_with_errors")
        .alias("status"),
    )


def find_job(jobs: DataFrame, reference: str) -> DataFrame:
    """The job with this id or idempotency key."""
    return jobs.where((F.col("id") == reference) | (F.col("idempotency_key") == reference))


def lookup_status(ids: DataFrame, jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Status of many ids: a job's when the id names one, otherwise the document's."""
    as_job = jobs.select("id", F.col("status").alias("_job"))
    as_document = docs.select("id", F.col("status").alias("_document"))
    return (
        ids.select("id").distinct()
        .join(as_job, "id", "left").join(as_document, "id", "left")
        .select(
            "id",
            F.when(F.col("_job").isNotNull(), "job")
            .when(F.col("_document").isNotNull(), "document").otherwise("not_found").alias("kind"),
            F.coalesce("_job", "_document").alias("status"),
        )
    )


def downloadable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("done", "completed_with_errors"))


def missing_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Downloadable jobs without a published artifact: an inconsistency."""
    return downloadable_jobs(jobs).join(
        artifacts.select(F.col("job_id").alias("id")), "id", "left_anti"
    )


def check_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated values of every unique key of the given tables."""
    found = None
    for name, frame in tables.items():
        for key in schemas.UNIQUE_KEYS[name]:
            repeated = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(
                F.col("copies") > 1
            ).select(
                F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key_value"),
                "copies",
            )
            found = repeated if found is None else found.unionByName(repeated)
    return found


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows that point at no parent row, for every reference between given tables."""
    found = None
    for child, column, parent, key in schemas.REFERENCES:
        if child not in tables or parent not in tables:
            continue
        wanted = tables[parent].select(F.col(key).alias(column))
        lost = (
            tables[child].where(F.col(column).isNotNull())
            .join(wanted, column, "left_anti").groupBy(column)
            .agg(F.count(F.lit(1)).alias("orphans"))
            .select(
                F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"),
                F.col(column).alias("missing_key"), "orphans",
            )
        )
        found = lost if found is None else found.unionByName(lost)
    return found


def check_aggregate(
    jobs: DataFrame, chunks: DataFrame, links: DataFrame, blocks: DataFrame
) -> DataFrame:
    """Jobs whose chunk count, chunk numbers or linked blocks do not fit together."""
    counted = (
        chunks.groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("job_id").agg(F.sum("_n").alias("_chunks"),
                               F.count_if(F.col("_n") > 1).alias("_repeats"))
    )
    owner = chunks.select(F.col("id").alias("chunk_id"), "job_id").join(
        jobs.select(F.col("id").alias("job_id"), F.col("document_id").alias("_job_document")),
        "job_id",
    )
    foreign = (
        links.join(owner, "chunk_id")
        .join(blocks.select(F.col("id").alias("block_id"),
                            F.col("document_id").alias("_block_document")), "block_id", "left")
        .groupBy("job_id")
        .agg(F.count_if(~F.col("_job_document").eqNullSafe(F.col("_block_document")))
             .alias("_foreign"))
    )
    zero = F.lit(0)
    return (
        jobs.select(F.col("id").alias("job_id"), "total_chunks")
        .join(counted, "job_id", "left")
        .join(foreign, "job_id", "left")
        .select(
            "job_id",
            (F.col("total_chunks") - F.coalesce("_chunks", zero)).cast("bigint")
            .alias("chunk_difference"),
            F.coalesce("_repeats", zero).alias("repeated_numbers"),
            F.coalesce("_foreign", zero).alias("foreign_blocks"),
        )
        .where((F.col("chunk_difference") != 0) | (F.col("repeated_numbers") > 0)
               | (F.col("foreign_blocks") > 0))
    )

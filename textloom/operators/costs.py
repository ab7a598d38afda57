"""Prices, attempts and usage accounting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import schemas
from textloom.functions import identity, text
from textloom.functions.ordered import SLOT_ROWS, number_rows, small_and_large


def _with_prices(df: DataFrame, model: str) -> DataFrame:
    # The price list is a few fixed rows: a map in the plan, so no join of any kind.
    listed = F.create_map(*[
        value for name, *rates in schemas.PRICES
        for value in (F.lit(name), F.array(*[F.lit(float(r)) for r in rates]))
    ])
    rates = F.try_element_at(listed, F.col(model))
    return df.select(
        "*", F.when(rates.isNotNull(), F.col(model)).alias("_model"),
        *[rates[i].alias(name) for i, name in enumerate(_PRICE_COLUMNS[1:])],
    )


_PRICE_COLUMNS = ("_model", "_in", "_cached", "_out")


def price(df: DataFrame, model: str = "model", name: str = "price_usd") -> DataFrame:
    """Cost of tokens_in and tokens_out, with ``price_error`` where there is none."""
    priced = _with_prices(df, model)
    bad_count = (F.col("tokens_in") < 0) | (F.col("tokens_out") < 0)
    error = F.when(bad_count, "negative_tokens").when(F.col("_model").isNull(), "unknown_model")
    cost = (F.col("tokens_in") * F.col("_in") + F.col("tokens_out") * F.col("_out")) / 1_000_000
    return priced.select(
        "*", error.alias("price_error"), F.when(error.isNull(), cost).alias(name)
    ).drop(*_PRICE_COLUMNS)


def price_cached(df: DataFrame, model: str = "model", name: str = "price_usd") -> DataFrame:
    """As ``price`` with cached_tokens_in at its own rate."""
    priced = _with_prices(df, model)
    tokens_in, cached = F.col("tokens_in"), F.col("cached_tokens_in")
    error = (
        F.when((tokens_in < 0) | (F.col("tokens_out") < 0), "negative_tokens")
        .when((cached < 0) | (cached > tokens_in), "bad_cached_tokens")
        .when(F.col("_model").isNull(), "unknown_model")
    )
    cost = (
        (tokens_in - cached) * F.col("_in")
        + cached * F.col("_cached")
        + F.col("tokens_out") * F.col("_out")
    ) / 1_000_000
    return priced.select(
        "*", error.alias("price_error"), F.when(error.isNull(), cost).alias(name)
    ).drop(*_PRICE_COLUMNS)


def price_attempts_lenient(attempts: DataFrame, key: str = "document_id") -> DataFrame:
    """Analysis usage per document: all attempts in the totals, the accepted one alone in
    the current plan; an unknown model costs nothing but its tokens count."""
    priced = price_cached(attempts, name="_usd")
    usd = F.coalesce("_usd", F.lit(0.0))
    accepted = F.col("accepted")
    return priced.groupBy(key).agg(
        F.sum(usd).alias("cost_usd_total"),
        F.sum("tokens_in").alias("tokens_in_total"),
        F.sum("tokens_out").alias("tokens_out_total"),
        F.coalesce(F.sum(F.when(accepted, usd)), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum(F.when(accepted, F.col("tokens_in"))), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.when(accepted, F.col("tokens_out"))), F.lit(0)).alias("tokens_out"),
    )


def estimate_chunk_cost(requests: DataFrame) -> DataFrame:
    """Upper estimate of one request before it is sent.

    Expects target_language, source_language, domain, register, terms, warnings, glossary,
    context_bytes, block_bytes and model. Bytes stand for tokens; output may triple.
    """
    def bytes_of(values: Column) -> Column:
        return F.aggregate(
            values, F.lit(0).cast("bigint"), lambda acc, v: acc + F.octet_length(v)
        )

    entries = F.transform(
        F.map_entries("glossary"), lambda e: F.concat(e["key"], F.lit(" → "), e["value"])
    )
    fields = [F.octet_length(c) for c in ("target_language", "source_language", "domain",
                                          "register")]
    tokens_in = sum(fields, F.lit(256).cast("bigint")) + bytes_of(F.col("terms")) + bytes_of(
        F.col("warnings")
    ) + bytes_of(entries) + F.col("context_bytes") + F.col("block_bytes")
    sized = requests.withColumn("tokens_in", tokens_in).withColumn(
        "tokens_out", F.greatest(F.lit(1).cast("bigint"), 3 * F.col("block_bytes"))
    )
    return price(sized, name="estimate_usd")


def _admission_scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by job and position; only the running cost of one job is kept."""
    job, spent = None, 0.0
    for batch in batches:
        verdicts = []
        for name, start, cap, estimate in zip(
            batch["job_id"], batch["spent_usd"], batch["cap_usd"], batch["estimate_usd"],
            strict=True,
        ):
            if name != job:
                job, spent = name, float(start)
            fits = spent + estimate <= cap
            spent += estimate if fits else 0.0
            verdicts.append(fits)
        yield batch[["job_id", "seq", "estimate_usd"]].assign(admitted=verdicts)


def admit_under_cap(chunks: DataFrame) -> DataFrame:
    """Admit chunks in order while the job's cost stays within its cap.

    A rejected chunk reserves nothing, so a later, smaller one may still pass; each verdict
    depends on all earlier ones. Jobs are spread over tasks and sorted, then scanned as a
    stream: a task holds one batch and one number, whatever the size of a job.
    Expects job_id, seq, estimate_usd, spent_usd and cap_usd.
    """
    ordered = (
        chunks.select("job_id", "seq", "estimate_usd", "spent_usd", "cap_usd")
        .repartition("job_id")
        .sortWithinPartitions("job_id", "seq")
    )
    seq_type = chunks.schema["seq"].dataType.simpleString()
    return ordered.mapInPandas(
        _admission_scan,
        f"job_id string, seq {seq_type}, estimate_usd double, admitted boolean",
    )


def day_bucket(col: Column) -> Column:
    return F.unix_date(F.to_date(col))


def number_attempts(log: DataFrame, most: int = SLOT_ROWS) -> DataFrame:
    """attempt_no from 1 in creation order within a chunk; ties go by id.

    Chunks with few attempts are numbered in one exchange, which later steps by chunk share; only
    those with very many are cut into days.
    """
    few, many = small_and_large(log, ["chunk_id"], most)
    order = [F.col("created_at"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))
    return few.withColumn("attempt_no", place.cast("bigint")).unionByName(number_rows(
        many, ["chunk_id"], order, day_bucket(F.col("created_at")), "attempt_no"))


def attempts_per_chunk(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every chunk with its highest attempt number, 0 without attempts."""
    top = attempts.groupBy("chunk_id").agg(F.max("attempt_no").alias("_top"))
    return (
        chunks.join(top, chunks["id"] == top["chunk_id"], "left")
        .withColumn("max_attempt_no", F.coalesce("_top", F.lit(0)).cast("bigint"))
        .drop("_top", "chunk_id")
    )


def next_attempt_no(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    return attempts_per_chunk(chunks, attempts).select(
        F.col("id").alias("chunk_id"), (F.col("max_attempt_no") + 1).alias("next_attempt_no")
    )


def remaining_attempts(per_chunk: DataFrame, max_attempts: int) -> DataFrame:
    """Attempts left after a retry baseline; 0 or less means exhausted."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    baseline = F.greatest(F.coalesce(F.col("baseline"), F.lit(0)), F.lit(0))
    used = F.greatest(F.lit(0), F.col("max_attempt_no") - baseline)
    left = (F.lit(max_attempts) - used).cast("bigint")
    return per_chunk.select("*", left.alias("remaining"), (left <= 0).alias("exhausted"))


def _job_of(attempts: DataFrame, chunks: DataFrame) -> DataFrame:
    links = chunks.select(F.col("id").alias("chunk_id"), "job_id", F.col("seq").alias("chunk_seq"))
    return attempts.join(links, "chunk_id")


def _per_chunk_usage(attempts: DataFrame) -> DataFrame:
    """Attempt sums per chunk, combined map-side before any join."""
    retry = F.col("attempt_no") > 1
    return attempts.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(retry).alias("retries"),
        F.sum("cost_usd").alias("cost"),
        F.sum(F.when(retry, F.col("cost_usd")).otherwise(0.0)).alias("retry_cost"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in schemas.OUTCOMES],
    )


def rollup_jobs(jobs: DataFrame, chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Tokens and cost of every job over all its attempts, 0 when it has none."""
    per_chunk = attempts.groupBy("chunk_id").agg(
        *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost_usd")]
    )
    per_job = _job_of(per_chunk, chunks).groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost_usd")]
    )
    return jobs.select(F.col("id").alias("job_id")).join(per_job, "job_id", "left").select(
        "job_id",
        F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
        F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    )


def usage_rollup(jobs: DataFrame, columns: Sequence[str] = ("model", "target_language", "status"),
                 measures: Sequence[str] = ("cost_usd",)) -> DataFrame:
    """Counts and sums of jobs for every prefix of ``columns`` at once, the empty one included.

    ``level`` is the number of columns that a row is grouped by; the others are null in it, which a
    null of their own does not count as. One shuffle serves all levels.
    """
    names = list(columns)
    sets = [names[:n] for n in range(len(names), -1, -1)]
    kept = sum((F.lit(1) - F.grouping(c) for c in names), F.lit(0))
    return jobs.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        kept.cast("int").alias("level"), F.count(F.lit(1)).alias("jobs"),
        *[F.sum(m).alias(m) for m in measures])


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, percent: int, name: str,
    most: int = SLOT_ROWS,
) -> DataFrame:
    """Exact nearest-rank percentile per key: the value at position ceil(p * n / 100).

    Values are counted per (key, value) first. Keys with few values are then walked in one task
    each. The others are counted per value range, so a key with very many rows is reduced in
    parallel and only its range summaries meet in one task. Both read the same counts.
    """
    kept = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    counts = kept.where(" and ".join([f"`{k}` is not null" for k in keys] or ["true"])).groupBy(
        *keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    scaled = F.floor(F.signum("_v") * F.log2(F.abs("_v") + 1) * 4096).cast("bigint")
    ranged = counts.withColumn("_range", F.coalesce(scaled, F.lit(0)))
    few, many = small_and_large(ranged, keys, most, F.col("_n"))
    whole = Window.partitionBy(*keys)
    # NaN is in range 0; other values rise with their ranges.
    place = ["_range", "_v"] if isinstance(
        counts.schema["_v"].dataType, T.FloatType | T.DoubleType) else ["_v"]
    target = F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("_total") / F.lit(100)))
    walked = (
        few.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_upto", F.sum("_n").over(whole.orderBy(*place).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
        .where((F.col("_upto") >= target) & (F.col("_upto") - F.col("_n") < target))
        .select(*keys, F.col("_v").alias(name))
    )
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        many.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(whole))
        .where((F.col("_before") < target) & (target <= F.col("_before") + F.col("_size")))
        .select(*keys, "_range", (target - F.col("_before")).alias("_want"))
    )
    running = (
        Window.partitionBy(*keys, "_range").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return walked.unionByName(
        many.join(ranges, [*keys, "_range"])
        .withColumn("_upto", F.sum("_n").over(running))
        .where(F.col("_upto") >= F.col("_want"))
        .groupBy(*keys)
        .agg(F.min("_v").alias(name))
    )


def quantile_sketches(
    df: DataFrame, keys: Sequence[str], value: str, size: int = 400, name: str = "sketch"
) -> DataFrame:
    """One mergeable KLL sketch per key: keep these rows and merge them for any coarser key.

    Sketches are built before the shuffle and have a few kilobytes whatever the number of rows.
    Null values and NaN are left out; a key with nothing else has no row.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.kll_sketch_agg_double(v, F.lit(size)).alias(name))


def merged_quantile(
    sketches: DataFrame, keys: Sequence[str], percent: float, name: str, sketch: str = "sketch"
) -> DataFrame:
    """keys, rows and an approximate percentile of all values behind the sketches of a key.

    With sketches of size 400 the answer's rank is off by at most one percent of the rows in 99 of
    100 cases; `nearest_rank` is the exact form.
    """
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double(sketch).alias("_all")).select(
        *keys, F.kll_sketch_get_n_double("_all").alias("rows"),
        F.kll_sketch_get_quantile_double("_all", F.lit(percent / 100.0)).alias(name))


def guarded_p95(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """95th percentile only where a key has at least 20 observations."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations")
    )
    ranked = nearest_rank(df, keys, value, 95, "_p95")
    return sizes.join(ranked, list(keys)).select(
        *keys, "observations", F.when(F.col("observations") >= 20, F.col("_p95")).alias(name)
    )


def job_latencies(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """The ordered latency list of every job, one row per attempt."""
    return _job_of(attempts, chunks).select("job_id", "chunk_seq", "attempt_no", "latency_ms")


def job_measurement(
    jobs: DataFrame, chunks: DataFrame, chunk_blocks: DataFrame, attempts: DataFrame
) -> DataFrame:
    """Usage, retries, outcomes, p95 attempt latency and latency of every job.

    The latency list itself is ``job_latencies``; nothing is collected per job here.
    """
    # One exchange of chunks serves usage, blocks and latencies.
    chunks = chunks.where(F.col("job_id").isNotNull()).select("id", "job_id", "seq")
    usage = _job_of(_per_chunk_usage(attempts), chunks).groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("attempts", "retries", "cost", "retry_cost", "tokens_in",
                                      "tokens_out", "n_ok", "n_retryable_error",
                                      "n_fatal_error")]
    )
    links = chunks.select(F.col("id").alias("chunk_id"), "job_id")
    block_counts = (
        chunk_blocks.select("chunk_id", identity.compact_id(F.col("block_id")).alias("block"))
        .join(links, "chunk_id").select("job_id", "block").distinct()
        .groupBy("job_id").agg(F.count(F.lit(1)).alias("block_count"))
    )
    tail = nearest_rank(
        _job_of(attempts, chunks), ["job_id"], "latency_ms", 95, "p95_attempt_latency_ms"
    )
    whole = (
        jobs.withColumnRenamed("id", "job_id").select(
            "job_id", "document_id", "target_language", "status", "model", "total_chunks",
            "done_chunks", "created_at", "updated_at",
        )
        .join(usage, "job_id", "left")
        .join(block_counts, "job_id", "left")
        .join(tail, "job_id", "left")
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    cost, retry_cost = zero("cost").cast("double"), zero("retry_cost").cast("double")
    return whole.select(
        "job_id", "document_id", "target_language", "status", "model", "total_chunks",
        "done_chunks",
        zero("block_count").alias("block_count"),
        text.millis_between(F.col("created_at"), F.col("updated_at")).alias("job_latency_ms"),
        zero("attempts").alias("attempt_count"),
        zero("retries").alias("retry_attempt_count"),
        retry_cost.alias("retry_cost_usd"),
        cost.alias("attempt_cost_usd"),
        F.when(cost != 0, 100.0 * retry_cost / cost).otherwise(0.0)
        .alias("retry_cost_share_percent"),
        zero("tokens_in").alias("attempt_tokens_in"),
        zero("tokens_out").alias("attempt_tokens_out"),
        zero("n_ok").alias("ok_count"),
        zero("n_retryable_error").alias("retryable_error_count"),
        zero("n_fatal_error").alias("fatal_error_count"),
        "p95_attempt_latency_ms",
    )


def outcome_counts(attempts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return attempts.groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("cost_usd").alias("cost_usd")
    )


def retry_spend(attempts: DataFrame) -> DataFrame:
    retry = F.col("attempt_no") > 1
    return attempts.agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum(F.when(retry, F.col("cost_usd"))), F.lit(0.0)).alias("retry_cost_usd"),
        F.count_if(retry).alias("retries"),
    )


def pipeline_usage(attempts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Known bulk and analysis usage, side by side and combined. One row."""
    parts = attempts.select(
        F.lit(1).alias("bulk"), "tokens_in", "tokens_out", "cost_usd"
    ).unionByName(
        analyses.select(
            F.lit(0).alias("bulk"),
            F.col("tokens_in_total").alias("tokens_in"),
            F.col("tokens_out_total").alias("tokens_out"),
            F.col("cost_usd_total").alias("cost_usd"),
        )
    )

    def total(column: str, bulk: int | None, zero: object) -> Column:
        value = F.col(column) if bulk is None else F.when(F.col("bulk") == bulk, F.col(column))
        return F.coalesce(F.sum(value), F.lit(zero))

    return parts.agg(
        total("cost_usd", None, 0.0).alias("known_cost_usd"),
        total("tokens_in", None, 0).alias("known_tokens_in"),
        total("tokens_out", None, 0).alias("known_tokens_out"),
        total("cost_usd", 1, 0.0).alias("bulk_cost_usd"),
        total("tokens_in", 1, 0).alias("bulk_tokens_in"),
        total("tokens_out", 1, 0).alias("bulk_tokens_out"),
        total("cost_usd", 0, 0.0).alias("triage_cost_usd"),
        total("tokens_in", 0, 0).alias("triage_tokens_in"),
        total("tokens_out", 0, 0).alias("triage_tokens_out"),
        F.count_if(F.col("bulk") == 1).alias("recorded_bulk_attempts"),
    )


def require_priced_models(models: Sequence[str]) -> list[str]:
    """Configured comparison models: non-empty, distinct and priced."""
    cleaned = [m.strip() for m in models]
    known = {row[0] for row in schemas.PRICES}
    if not cleaned or any(not m for m in cleaned):
        raise ValueError("model names must not be empty")
    if len(set(cleaned)) != len(cleaned):
        raise ValueError("model names must be distinct")
    if unknown := [m for m in cleaned if m not in known]:
        raise ValueError(f"no price for {unknown[0]}")
    return cleaned


def model_comparison(
    models: Sequence[str], usage: DataFrame, quality: DataFrame | None = None
) -> DataFrame:
    """One row per configured model, in the configured order.

    ``usage`` has model, tokens_in, tokens_out, cost_usd and bulk (true for provider
    requests); ``quality`` has model, chrf and preservation_percent.
    """
    names = require_priced_models(models)
    spark: SparkSession = usage.sparkSession
    wanted = spark.createDataFrame(list(enumerate(names)), "position int, model string")
    sums = usage.groupBy("model").agg(
        F.sum("cost_usd").alias("cost"), F.sum("tokens_in").alias("tin"),
        F.sum("tokens_out").alias("tout"), F.count_if("bulk").alias("requests"),
    )
    tokens = F.coalesce(F.col("tin") + F.col("tout"), F.lit(0))
    rows = wanted.join(sums, "model", "left")
    if quality is not None:
        rows = rows.join(quality, "model", "left")
    return rows.select(
        "position",
        "model",
        F.when(tokens > 0, F.col("cost") * 1_000_000 / tokens)
        .alias("cost_per_million_mixed_tokens_usd"),
        F.coalesce("cost", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("tin", F.lit(0)).alias("tokens_in"),
        F.coalesce("tout", F.lit(0)).alias("tokens_out"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
        *(["chrf", "preservation_percent"] if quality is not None else []),
    ).orderBy("position")


def merge_analysis(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """Current analysis and cumulative totals per document from its save history.

    ``history`` has document_id, save_no (order of saves), triage_status, tokens_in,
    tokens_out, cost_usd and any plan columns. A degraded save never replaces an ok one, an ok
    plan saved again without usage changes nothing, and saves after the document's first job
    (``saved_at`` against the jobs' created_at) are ignored.
    """
    frozen = jobs.groupBy("document_id").agg(F.min("created_at").alias("_frozen_at"))
    live = history.join(frozen, "document_id", "left").where(
        F.col("_frozen_at").isNull() | (F.col("saved_at") <= F.col("_frozen_at"))
    ).drop("_frozen_at")
    is_ok = F.col("triage_status") == "ok"
    first_ok = live.where(is_ok).groupBy("document_id").agg(
        F.min("save_no").alias("_first_ok")
    )
    no_usage = (F.col("tokens_in") == 0) & (F.col("tokens_out") == 0) & (F.col("cost_usd") == 0)
    after_ok = F.col("save_no") > F.col("_first_ok")
    applied = live.join(first_ok, "document_id", "left").where(
        F.col("_first_ok").isNull() | ~after_ok | (is_ok & ~no_usage)
    ).drop("_first_ok")
    totals = applied.groupBy("document_id").agg(
        F.max_by(
            F.struct(*[c for c in applied.columns if c not in ("document_id",)]), "save_no"
        ).alias("_now"),
        F.sum("cost_usd").alias("cost_usd_total"),
        F.sum("tokens_in").alias("tokens_in_total"),
        F.sum("tokens_out").alias("tokens_out_total"),
    )
    return totals.select(
        "document_id", "_now.*", "cost_usd_total", "tokens_in_total", "tokens_out_total"
    )


def analysis_costs(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    """Cumulative analysis cost of the requested documents."""
    return analyses.join(ids.select("document_id"), "document_id", "left_semi").select(
        "document_id", "cost_usd_total"
    )


def attribute_shared_cost(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Document cost shown on one job per document, with the number of jobs sharing it.

    The job that shows it is the newest visible one. Uses an aggregate and a join rather than
    a window so that a document with very many jobs is not sent to one task.
    """
    shown = jobs.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("sharing_jobs"),
        F.min_by("id", F.struct(-F.unix_micros("created_at"), "id")).alias("_shown_on"),
    )
    costs = analyses.select("document_id", "cost_usd_total")
    per_document = shown.join(costs, "document_id", "left")
    return jobs.join(per_document, "document_id").select(
        F.col("id").alias("job_id"),
        "document_id",
        "sharing_jobs",
        F.when(F.col("id") == F.col("_shown_on"), F.coalesce("cost_usd_total", F.lit(0.0)))
        .alias("shown_cost_usd"),
    )


def document_expense(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Job costs plus the analysis total, once per document."""
    spent = jobs.groupBy("document_id").agg(
        F.sum("cost_usd").alias("jobs_usd"), F.count(F.lit(1)).alias("jobs")
    )
    costs = analyses.select("document_id", "cost_usd_total")
    return spent.join(costs, "document_id", "full_outer").select(
        "document_id",
        F.coalesce("jobs", F.lit(0)).alias("jobs"),
        (F.coalesce("jobs_usd", F.lit(0.0)) + F.coalesce("cost_usd_total", F.lit(0.0)))
        .alias("total_usd"),
    )

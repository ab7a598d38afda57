"""Structured Streaming jobs: job events, stale leases, idempotency, metrics, translation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom import schemas
from textloom.functions.ordered import previous_value
from textloom.operators import inference, reuse

# --- job event feed ------------------------------------------------------------------


def event_name(status: Column, previous: Column) -> Column:
    return (
        F.when(status == "failed", "error")
        .when(status.isin(*schemas.TERMINAL_STATUSES), "done")
        .when(previous.isNull() | (status != previous), "status")
        .otherwise("progress")
    )


def job_event_feed(observations: DataFrame, bucket: Column) -> DataFrame:
    """Named events of every job in time order, none after its first terminal state.

    ``observations``: job_id, ts, event_id, status.
    """
    terminal = F.col("status").isin(*schemas.TERMINAL_STATUSES)
    ends = observations.where(terminal).groupBy("job_id").agg(
        F.min(F.struct("ts", "event_id")).alias("_end")
    )
    place = F.struct("ts", "event_id")
    live = observations.join(ends, "job_id", "left").where(
        F.col("_end").isNull() | (place <= F.col("_end"))
    ).drop("_end")
    known = previous_value(
        live, ["job_id"], [F.col("ts"), F.col("event_id")], F.col("status"), bucket, "_previous"
    )
    return known.withColumn("event", event_name(F.col("status"), F.col("_previous"))).drop(
        "_previous"
    )


class _PreviousStatus(StatefulProcessor):
    """Puts the status before beside every observation; a terminal status closes the job.

    The key is a slot of jobs, whose rows are handled in bulk: reading and writing state for every
    single job costs more than the work itself. One timer per slot, at the earliest deadline of its
    jobs, drops what is kept of a job some event time after it was last heard of.
    """

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._jobs = handle.getValueState(
            "jobs", "job_id array<string>, status array<string>, deadline_ms array<bigint>")

    def _stored(self) -> dict:
        state = self._jobs.get()
        return {} if state is None else {
            job: (status, deadline) for job, status, deadline in zip(*state, strict=True)}

    def _store(self, known: dict) -> None:
        if not known:
            self._jobs.clear()
            return
        statuses, deadlines = zip(*known.values(), strict=True)
        self._jobs.update((list(known), list(statuses), list(deadlines)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = self._stored()
        # Order is by event time, so a job's rows of this micro-batch are needed together.
        found = pd.concat(list(rows), ignore_index=True)
        codes, jobs = pd.factorize(found["job_id"], use_na_sentinel=False)
        jobs = [None if pd.isna(job) else job for job in jobs]
        last = np.array([known.get(job, (None, None))[0] for job in jobs], dtype=object)
        closed = np.array([status in schemas.TERMINAL_STATUSES for status in last], dtype=bool)
        found = found.assign(_code=codes)[~closed[codes]].sort_values(["_code", "ts", "event_id"])
        if found.empty:
            return
        code = found["_code"].to_numpy()
        first = np.concatenate(([True], code[1:] != code[:-1]))
        previous = found["status"].shift().to_numpy(dtype=object, copy=True)
        previous[first] = last[code[first]]
        # Rows after a job's first terminal one are left out.
        ended = found["status"].isin(schemas.TERMINAL_STATUSES).to_numpy()
        before = np.cumsum(ended) - ended
        live = before == before[first][np.cumsum(first) - 1]
        found, code = found.assign(previous=previous)[live], code[live]
        tips = found[np.concatenate((code[1:] != code[:-1], [True]))]
        watermark = timerValues.getCurrentWatermarkInMs()
        timer = min((deadline for _, deadline in known.values()), default=None)
        times = pd.DatetimeIndex(tips["ts"]).as_unit("ms").asi8
        for at, status, ms in zip(tips["_code"], tips["status"], times, strict=True):
            deadline = int(ms) + self._keep
            if deadline > watermark:
                known[jobs[at]] = (status, deadline)
            else:
                known.pop(jobs[at], None)
        self._move_timer(timer, known)
        self._store(known)
        yield found[["job_id", "event_id", "ts", "status", "previous"]]

    def _move_timer(self, timer: int | None, known: dict) -> None:
        earliest = min((deadline for _, deadline in known.values()), default=None)
        if timer == earliest:
            return
        if timer is not None:
            self._handle.deleteTimer(timer)
        if earliest is not None:
            self._handle.registerTimer(earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # The timer that has run out is removed by the caller.
        expired = max(expiredTimerInfo.getExpiryTimeInMs(),
                      timerValues.getCurrentWatermarkInMs() - 1)
        known = {job: kept for job, kept in self._stored().items() if kept[1] > expired}
        self._move_timer(None, known)
        self._store(known)
        yield pd.DataFrame({"job_id": [], "event_id": [], "ts": [], "status": [], "previous": []}).astype(
            {"job_id": str, "event_id": "int64", "ts": "datetime64[ns]", "status": str,
             "previous": str})

    def close(self) -> None:
        pass


def job_event_stream(
    observations: DataFrame, lateness: str = "7 days", keep_days: float = 30, slots: int = 4096
) -> DataFrame:
    """Streaming form of ``job_event_feed``, by event time.

    State is one status per job, dropped when the watermark is ``keep_days`` past the job's last
    observation. Observations that are later than ``lateness`` are not told. Jobs are hashed into
    ``slots``, whose state is read and written together: some hundred open jobs each are cheap.
    The number stays the same over the life of a checkpoint.
    """
    told = observations.select(
        "job_id", "event_id", "ts", "status",
        F.pmod(F.xxhash64("job_id"), F.lit(slots)).cast("int").alias("slot"),
    ).withWatermark("ts", lateness).groupBy("slot").transformWithStateInPandas(
        _PreviousStatus(int(keep_days * 86_400_000)),
        outputStructType="job_id string, event_id bigint, ts timestamp, status string, "
        "previous string",
        outputMode="Append",
        timeMode="EventTime",
    )
    return told.select(
        "job_id", "event_id", "ts", "status",
        event_name(F.col("status"), F.col("previous")).alias("event"),
    )


# --- stale leases --------------------------------------------------------------------


class _LeaseWatch(StatefulProcessor):
    """One timer per chunk at the end of its lease plus the grace period."""

    def __init__(self, grace_ms: int) -> None:
        self._grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._lease = handle.getValueState("lease", "lease_ms bigint, deadline_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        if self._lease.exists():
            self._handle.deleteTimer(self._lease.get()[1])
            self._lease.clear()
        # The newest observation decides: no lease means that the chunk was let go. One row is
        # held at a time, whatever number arrives.
        last = None
        for part in rows:
            top = part.sort_values(["ts", "lease_ms"]).iloc[-1]
            if last is None or self._place(top) >= self._place(last):
                last = top
        newest = last["lease_ms"]
        if pd.notna(newest):
            # Strictly after the deadline, so one millisecond is added.
            deadline = int(newest) + self._grace + 1
            if deadline <= timerValues.getCurrentWatermarkInMs():
                yield pd.DataFrame({"chunk_id": [key[0]], "lease_ms": [int(newest)]})
            else:
                self._handle.registerTimer(deadline)
                self._lease.update((int(newest), deadline))

    @staticmethod
    def _place(row) -> tuple:
        return row["ts"], pd.isna(row["lease_ms"]), 0 if pd.isna(row["lease_ms"]) else row["lease_ms"]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._lease.exists():
            lease = self._lease.get()[0]
            self._lease.clear()
            yield pd.DataFrame({"chunk_id": [key[0]], "lease_ms": [int(lease)]})

    def close(self) -> None:
        pass


def stale_monitor(leases: DataFrame, grace_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """Chunks whose lease was not renewed for the grace period, by event time.

    ``leases``: chunk_id, ts, lease_expires_at (null when the chunk is no longer held).
    """
    shaped = leases.select(
        "chunk_id", "ts", F.unix_millis("lease_expires_at").alias("lease_ms")
    ).withWatermark("ts", lateness)
    return shaped.groupBy("chunk_id").transformWithStateInPandas(
        _LeaseWatch(grace_seconds * 1000),
        outputStructType="chunk_id string, lease_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


# --- idempotency, metrics ------------------------------------------------------------


def dedup_requests(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First request of every idempotency key within the watermark."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(
        ["idempotency_key"]
    )


def streaming_metrics(
    observations: DataFrame, width: str = "1 day", lateness: str = "1 day"
) -> DataFrame:
    """Observations and cost per window and status. Works on static frames too."""
    timed = observations.withWatermark("ts", lateness) if observations.isStreaming else observations
    return timed.groupBy(F.window("ts", width), "status").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("cost_usd").alias("cost_usd")
    ).select(F.col("window.start").alias("window_start"), "status", "observations", "cost_usd")


# --- incremental translation ---------------------------------------------------------


def incremental_translate(
    blocks: DataFrame,
    memory_path: str,
    provider: inference.Provider,
    checkpoint: str,
    **options,
):
    """Translate what new blocks add to the memory table; start it with a trigger.

    ``blocks`` is a stream of translation_key, source_hash, source_text, target_language,
    model. Every micro-batch writes its own folder, so a batch that runs again after a lost
    executor replaces what it wrote before, and earlier batches are never inferred again. Texts
    whose calls failed for a time are kept beside the memory and taken up by the next batch.
    Results lie in folders by the beginning of their hash, and a batch reads those it needs.
    """
    keys = [*reuse.KEY, "target_language", "model"]

    def translate(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        waiting = _stored(
            spark, f"{memory_path}.retry/batch={epoch - 1}",
            "translation_key string, source_hash string, source_text string, "
            "target_language string, model string")
        asked = batch.select(*keys, "source_text").unionByName(waiting.select(*keys, "source_text"))
        # At most 256 beginnings of two hexadecimal digits.
        beginnings = [r[0] for r in asked.select(_beginning()).distinct().collect()]
        known = read_memory(spark, memory_path, epoch, beginnings)
        units = reuse.new_units(asked, known, ["target_language", "model"])
        folder = f"{memory_path}/batch={epoch}"
        inference.infer(units, provider, **options).withColumn(
            "created_at", F.current_timestamp()
        ).withColumn("beginning", _beginning()).write.mode("overwrite").partitionBy(
            "beginning").parquet(folder)
        again = [code for code, _, retryable in schemas.ERRORS if retryable]
        failed = _stored(spark, folder, f"{inference.RESULT}, created_at timestamp").where(
            F.col("error_code").isin(again)).select(*keys)
        asked.join(failed, keys, "left_semi").dropDuplicates(keys).write.mode(
            "overwrite").parquet(f"{memory_path}.retry/batch={epoch}")

    return (
        blocks.writeStream.foreachBatch(translate).option("checkpointLocation", checkpoint)
    )


def _beginning() -> Column:
    return F.substring("source_hash", 1, 2).alias("beginning")


def _stored(spark, path: str, schema: str) -> DataFrame:
    """Rows of a folder, none where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_memory(
    spark, memory_path: str, before: int | None = None, beginnings: list[str] | None = None
) -> DataFrame:
    """Stored translations; ``before`` leaves out a batch that is being written again,
    ``beginnings`` reads only hashes that begin so."""
    rows = _stored(spark, memory_path, (
        f"{inference.RESULT}, created_at timestamp, batch int, beginning string"))
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if beginnings is not None:
        rows = rows.where(F.col("beginning").isin(beginnings))
    return rows.where(F.col("translated_text").isNotNull()).select(
        "translation_key", "source_hash", "translated_text", "created_at"
    )

"""Streams replayed from files, against their batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import inference
from textloom.streaming import feeds

START = datetime(2024, 1, 1)
OBSERVED = "job_id string, event_id bigint, ts timestamp, status string, cost_usd double"


def observe(spark, folder, rows):
    frame = spark.createDataFrame(
        [(j, i, START + timedelta(minutes=m), s, 1.0) for j, i, m, s in rows], OBSERVED)
    frame.coalesce(1).write.mode("append").parquet(folder)


def run(spark, frame, root, mode="append"):
    query = (frame.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", f"{root}/state").option("path", f"{root}/out")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{root}/out")


def test_event_feed_across_batches(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    first = [("a", 1, 0, "queued"), ("a", 2, 1, "running"), ("b", 9, 0, "running")]
    second = [("a", 3, 2, "running"), ("a", 4, 3, "done"), ("a", 5, 4, "done"),
              ("b", 10, 1, "failed"), ("b", 11, 2, "running")]
    for rows in (first, second):
        observe(spark, folder, rows)
        stream = spark.readStream.schema(OBSERVED).parquet(folder)
        out = run(spark, feeds.job_event_stream(stream), root)
    got = {(r.event_id, r.event) for r in out.collect()}
    assert got == {(1, "status"), (2, "status"), (3, "progress"), (4, "done"), (9, "status"),
                   (10, "error")}
    batch = feeds.job_event_feed(spark.read.parquet(folder), F.unix_date(F.to_date("ts")))
    assert {(r.event_id, r.event) for r in batch.collect()} == got


def test_event_feed_handles_many_jobs_of_a_slot_together(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    states = ("queued", "running", "running", "done", "running")
    rows = [(f"j{j}", 100 * j + i, 7 * j % 50 + i, states[(i + j % 4) % 5])
            for j in range(120) for i in range(5)]
    for part in ([r for r in rows if r[1] % 100 < 2], [r for r in rows if r[1] % 100 > 1]):
        observe(spark, folder, part)
        stream = spark.readStream.schema(OBSERVED).parquet(folder)
        query = (feeds.job_event_stream(stream, slots=3).writeStream.format("parquet")
                 .option("checkpointLocation", f"{root}/state").option("path", f"{root}/out")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        # Not one state row and one timer per job.
        assert state["numRowsTotal"] <= 12
    batch = feeds.job_event_feed(spark.read.parquet(folder), F.unix_date(F.to_date("ts")))
    columns = ["job_id", "event_id", "status", "event"]
    assert sorted(spark.read.parquet(f"{root}/out").select(*columns).collect()) == sorted(
        batch.select(*columns).collect())


def test_event_feed_forgets_each_job_of_a_slot_in_its_time(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    day = 1440
    batches = ([("old", 1, 0, "running"), ("new", 2, 3 * day, "running")],
               [("clock", 3, 5 * day, "running")], [("clock", 4, 5 * day + 1, "running")],
               [("old", 5, 5 * day, "running"), ("new", 6, 5 * day, "running")])
    for rows in batches:
        observe(spark, folder, rows)
        stream = spark.readStream.schema(OBSERVED).parquet(folder)
        out = run(spark, feeds.job_event_stream(stream, "1 day", 3, slots=1), root)
    got = {r.event_id: r.event for r in out.collect()}
    assert got == {1: "status", 2: "status", 3: "status", 4: "progress", 5: "status",
                   6: "progress"}


def test_renewed_leases_are_not_stale(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("quiet", 0, 1), ("kept", 0, 1), ("kept", 50, 100), ("freed", 0, 1), ("freed", 2, None),
            ("clock", 60, 200)]
    frame = spark.createDataFrame(
        [(c, START + timedelta(minutes=m), None if e is None else START + timedelta(minutes=e))
         for c, m, e in rows], "chunk_id string, ts timestamp, lease_expires_at timestamp")
    frame.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    out = run(spark, feeds.stale_monitor(stream, 120), str(tmp_path / "run"))
    assert [r.chunk_id for r in out.collect()] == ["quiet"]


def test_repeated_requests_pass_once(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    for batch in ([("k", 0), ("l", 1), ("k", 2)], [("k", 3), ("m", 4)]):
        spark.createDataFrame([(k, START + timedelta(minutes=m)) for k, m in batch],
                              "idempotency_key string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(folder)
        stream = spark.readStream.schema("idempotency_key string, ts timestamp").parquet(folder)
        out = run(spark, feeds.dedup_requests(stream), root)
    assert sorted(r.idempotency_key for r in out.collect()) == ["k", "l", "m"]


def test_metrics_per_window(spark):
    rows = [(str(i), i, START + timedelta(hours=13 * i), "done", 1.5) for i in range(4)]
    got = feeds.streaming_metrics(spark.createDataFrame(rows, OBSERVED)).collect()
    assert sorted((r.observations, r.cost_usd) for r in got) == [(2, 3.0), (2, 3.0)]


UNITS = ("translation_key string, source_hash string, source_text string, target_language string, "
         "model string")


def test_incremental_translation_never_repeats_stored_work(spark, tmp_path):
    class CountingProvider:
        def __init__(self, folder):
            self.folder = folder

        def translate(self, source, language, model):
            import os
            open(os.path.join(self.folder, f"{source}-{os.urandom(6).hex()}"), "w").close()
            if source == "no":
                raise inference.ProviderFailure("provider_refusal")
            return source.upper(), 1, 1

    folder, calls = str(tmp_path / "in"), tmp_path / "calls"
    calls.mkdir()
    for batch in (["a", "b", "a", "no"], ["b", "c"], ["a", "c"]):
        spark.createDataFrame([("k", s, s, "de", "m") for s in batch], UNITS).coalesce(1).write.mode(
            "append").parquet(folder)
        stream = spark.readStream.schema(UNITS).parquet(folder)
        feeds.incremental_translate(
            stream, str(tmp_path / "memory"), CountingProvider(str(calls)),
            str(tmp_path / "state"), wait=lambda s: None,
        ).trigger(availableNow=True).start().awaitTermination()
    stored = feeds.read_memory(spark, str(tmp_path / "memory")).collect()
    assert sorted(r.translated_text for r in stored) == ["A", "B", "C"]
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["a", "b", "c", "no"]


def test_texts_that_failed_for_a_time_are_taken_up_again(spark, tmp_path):
    class Moody:
        def __init__(self, sign):
            self.sign = sign

        def translate(self, source, language, model):
            import os
            if source == "late" and not os.path.exists(self.sign):
                raise inference.ProviderFailure("provider_timeout", 3, 0)
            return source.upper(), 1, 1

    folder, sign = str(tmp_path / "in"), tmp_path / "well"
    for batch in (["a", "late"], ["b"], ["c"]):
        spark.createDataFrame([("k", s, s, "de", "m") for s in batch], UNITS).coalesce(1).write.mode(
            "append").parquet(folder)
        feeds.incremental_translate(
            spark.readStream.schema(UNITS).parquet(folder), str(tmp_path / "memory"),
            Moody(str(sign)), str(tmp_path / "state"), max_attempts=1,
        ).trigger(availableNow=True).start().awaitTermination()
        if batch == ["b"]:
            sign.touch()
    stored = feeds.read_memory(spark, str(tmp_path / "memory")).collect()
    assert sorted(r.translated_text for r in stored) == ["A", "B", "C", "LATE"]
    assert all(r.created_at for r in stored)


@pytest.fixture(autouse=True)
def small_state(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")

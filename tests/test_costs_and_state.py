"""Accounting and operational state."""

import bisect
import json
import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import ordered, text
from textloom.operators import costs, inference, state

START = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_prices(spark):
    rows = [("gpt-4o-mini", 1_000_000, 1_000_000), ("gpt-4o-mini", 200_000, 100_000),
            ("gpt-4o", 1_000_000, 0), ("gpt-4o", 0, 1_000_000), ("other", 1, 1),
            ("gpt-4o", -1, 0)]
    frame = spark.createDataFrame(rows, "model string, tokens_in int, tokens_out int")
    got = [(r.price_usd, r.price_error) for r in costs.price(frame).collect()]
    assert [p for p, _ in got[:4]] == pytest.approx([0.75, 0.09, 2.5, 10.0])
    assert got[4:] == [(None, "unknown_model"), (None, "negative_tokens")]


def test_cached_prices(spark):
    rows = [(100_000, 0), (100_000, 100_000), (10, -1), (10, 11)]
    frame = spark.createDataFrame(rows, "tokens_in int, cached_tokens_in int").withColumns(
        {"model": F.lit("gpt-4o-mini"), "tokens_out": F.lit(0)})
    got = [(r.price_usd, r.price_error) for r in costs.price_cached(frame).collect()]
    assert [p for p, _ in got[:2]] == pytest.approx([0.015, 0.0075])
    assert {e for _, e in got[2:]} == {"bad_cached_tokens"}


def attempts_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, attempt_no int, tokens_in int, "
                                       "tokens_out int, cost_usd double, latency_ms int, "
                                       "outcome string")


def test_rollup_and_measurement(spark):
    jobs = spark.createDataFrame(
        [("j", "d", "de", "done", "gpt-4o", 2, 2, at(0), at(1.5005)),
         ("k", "d", "fr", "queued", "gpt-4o", 0, 0, at(5), at(4))],
        "id string, document_id string, target_language string, status string, model string, "
        "total_chunks int, done_chunks int, created_at timestamp, updated_at timestamp")
    chunks = spark.createDataFrame([("c1", "j", 0), ("c2", "j", 1)], "id string, job_id string, "
                                                                     "seq int")
    attempts = attempts_frame(spark, [("c1", 1, 10, 5, .01, 30, "retryable_error"),
                                      ("c1", 2, 20, 8, .02, 10, "ok"),
                                      ("c2", 1, 2, 1, .005, 20, "fatal_error")])
    rolled = {r.job_id: r for r in costs.rollup_jobs(jobs, chunks, attempts).collect()}
    assert (rolled["j"].tokens_in, rolled["j"].tokens_out) == (32, 14)
    assert rolled["j"].cost_usd == pytest.approx(0.035) and rolled["k"].cost_usd == 0
    links = spark.createDataFrame([("c1", "b1"), ("c2", "b1"), ("c2", "b2")],
                                  "chunk_id string, block_id string")
    rows = {r.job_id: r for r in
            costs.job_measurement(jobs, chunks, links, attempts).collect()}
    j, k = rows["j"], rows["k"]
    assert (j.block_count, j.attempt_count, j.retry_attempt_count) == (2, 3, 1)
    assert (j.job_latency_ms, k.job_latency_ms) == (1500, 0)
    assert j.retry_cost_share_percent == pytest.approx(100 * .02 / .035)
    assert j.p95_attempt_latency_ms == 30 and k.p95_attempt_latency_ms is None
    assert (j.ok_count, j.retryable_error_count, j.fatal_error_count) == (1, 1, 1)


@pytest.mark.parametrize("percent", [1, 50, 95, 100])
def test_nearest_rank(spark, percent):
    rng = random.Random(percent)
    groups = {f"g{n}": [rng.choice([rng.random() * 1e6, rng.randint(-5, 5), 7.0])
                        for _ in range(n)] for n in (1, 2, 19, 20, 21, 500)}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs],
                                  "g string, v double")
    got = {r.g: r.p for r in costs.nearest_rank(frame, ["g"], "v", percent, "p").collect()}
    assert got == {g: sorted(vs)[max(0, math.ceil(percent * len(vs) / 100) - 1)]
                   for g, vs in groups.items()}


@pytest.mark.parametrize("most", [0, 30, 10**6])
@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_nearest_rank_of_large_and_small_keys(spark, kind, most):
    rng = random.Random(most)
    rows = [(rng.choice("aaaaab") if rng.random() < .5 else f"k{rng.randint(0, 60)}",
             rng.choice([None, rng.randint(-50, 50), rng.randint(0, 10**6)])) for _ in range(900)]
    frame = spark.createDataFrame([*rows, (None, 1)], "g string, v bigint").withColumn(
        "v", F.col("v").cast(kind))
    got = {r.g: r.p for r in costs.nearest_rank(frame, ["g"], "v", 95, "p", most).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: sorted(vs)[math.ceil(95 * len(vs) / 100) - 1] for g, vs in groups.items()}


def test_merged_sketches_keep_the_rank(spark):
    rng = random.Random(4)
    rows = [(g, day, rng.choice([rng.gauss(0, 1e3), float(rng.randint(0, 9))]))
            for g, n in (("one", 1), ("few", 30), ("many", 20000)) for day in range(5)
            for _ in range(n)]
    frame = spark.createDataFrame(
        [*rows, ("none", 1, None), ("few", 1, None), ("few", 2, float("nan"))],
        "g string, day int, v double").repartition(7)
    daily = costs.quantile_sketches(frame, ["g", "day"], "v")
    assert daily.count() == 15
    for percent in (5, 50, 95):
        got = {r.g: r for r in costs.merged_quantile(daily, ["g"], percent, "p").collect()}
        assert set(got) == {"one", "few", "many"}
        for g, r in got.items():
            values = sorted(v for key, _, v in rows if key == g)
            assert r.rows == len(values) and r.p in values
            low, high = bisect.bisect_left(values, r.p), bisect.bisect_right(values, r.p)
            slack = 0.02 * len(values) + 1
            assert low - slack <= percent / 100 * len(values) <= high + slack
    assert costs.merged_quantile(daily.limit(0), ["g"], 95, "p").count() == 0


def test_guarded_p95(spark):
    frame = spark.createDataFrame([("a", i) for i in range(19)] + [("b", i) for i in range(20)],
                                  "g string, v int")
    got = {r.g: r.p for r in costs.guarded_p95(frame, ["g"], "v", "p").collect()}
    assert got == {"a": None, "b": 18}


def test_admission_is_a_greedy_scan(spark):
    rng = random.Random(2)
    rows = [(f"j{j}", s, float(rng.randint(1, 40)), 5.0, 60.0) for j in range(30)
            for s in range(rng.randint(1, 30))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id string, seq int, estimate_usd double, "
                                        "spent_usd double, cap_usd double")
    expected, spent = {}, {}
    for job, seq, cost, start, cap in sorted(rows):
        now = spent.setdefault(job, start)
        expected[job, seq] = now + cost <= cap
        spent[job] = now + cost * expected[job, seq]
    got = {(r.job_id, r.seq): r.admitted for r in costs.admit_under_cap(frame).collect()}
    assert got == expected


def test_attempt_numbers(spark):
    log = spark.createDataFrame([("c", at(9), "x"), ("c", at(90_000), "y"), ("c", at(9), "a"),
                                 ("d", None, "z")],
                                "chunk_id string, created_at timestamp, id string")
    got = {r.id: r.attempt_no for r in costs.number_attempts(log).collect()}
    assert got == {"a": 1, "x": 2, "y": 3, "z": 1}
    chunks = spark.createDataFrame([("c", 1), ("e", 0)], "id string, baseline int")
    numbered = costs.number_attempts(log)
    nexts = {r.chunk_id: r.next_attempt_no for r in costs.next_attempt_no(chunks, numbered)
             .collect()}
    assert nexts == {"c": 4, "e": 1}
    left = costs.remaining_attempts(costs.attempts_per_chunk(chunks, numbered), 2).collect()
    assert {r.id: (r.remaining, r.exhausted) for r in left} == {"c": (0, True), "e": (2, False)}


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_attempt_numbers_of_large_and_small_chunks(spark, most):
    rng = random.Random(most)
    rows = [("hot" if rng.random() < .4 else f"c{rng.randint(0, 40)}",
             rng.choice([None, at(rng.randint(0, 10) * 86_400)]), f"{i:03d}") for i in range(400)]
    log = spark.createDataFrame([*rows, (None, at(1), "x")],
                                "chunk_id string, created_at timestamp, id string")
    got = {r.id: r.attempt_no for r in costs.number_attempts(log, most).collect()}
    expected, seen = {}, {}
    for c, t, i in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or at(0), r[2])):
        expected[i] = seen[c] = seen.get(c, 0) + 1
    assert got == expected


def test_measurement_reads_attempts_and_chunks_in_few_exchanges(spark):
    day = "timestamp'2024-01-01'"
    jobs = spark.range(40).selectExpr(
        "cast(id as string) id", "'d' document_id", "'de' target_language", "'done' status",
        "'m' model", "1 total_chunks", "1 done_chunks", f"{day} created_at", f"{day} updated_at")
    chunks = spark.range(80).selectExpr(
        "concat('c', id) id", "cast(id % 38 as string) job_id", "cast(id as int) seq")
    uuid = "concat('0000000', id % 9, '-0000-0000-0000-', lpad(id % 5, 12, '0'))"
    links = spark.range(400).selectExpr(
        "concat('c', id % 80) chunk_id", f"if(id % 2 = 0, {uuid}, replace({uuid}, '-')) block_id")
    log = spark.range(300).selectExpr(
        "concat('c', id % 80) chunk_id", "1 tokens_in", "2 tokens_out", "0.5D cost_usd",
        "id % 90 latency_ms", "'ok' outcome", "timestamp_seconds(id * 40000) created_at",
        "cast(id as string) id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = costs.job_measurement(jobs, chunks, links, costs.number_attempts(log))
        got = {int(r.job_id): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for j in range(40):
        mine = [i for i in range(300) if i % 80 % 38 == j and j < 38]
        blocks = {(i % 2, i % 9, i % 5) for i in range(400) if i % 80 % 38 == j and j < 38}
        late = sorted(i % 90 for i in mine)
        assert (got[j].attempt_count, got[j].block_count) == (len(mine), len(blocks))
        assert got[j].retry_attempt_count == sum(i >= 80 for i in mine)
        assert got[j].p95_attempt_latency_ms == (
            late[math.ceil(95 * len(late) / 100) - 1] if late else None)
    # There were 27: attempts numbered by day, counts of latencies derived twice, chunks per use.
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 14


def test_merge_analysis(spark):
    schema = ("document_id string, save_no int, saved_at timestamp, triage_status string, "
              "tokens_in int, tokens_out int, cost_usd double")
    rows = [("up", 1, at(1), "degraded", 5, 1, 1.0), ("up", 2, at(2), "ok", 7, 2, 2.0),
            ("up", 3, at(3), "ok", 0, 0, 0.0), ("up", 4, at(4), "degraded", 9, 9, 9.0),
            ("up", 5, at(5), "ok", 1, 1, 0.5), ("cold", 1, at(1), "degraded", 3, 3, 3.0),
            ("cold", 2, at(9), "ok", 4, 4, 4.0)]
    jobs = spark.createDataFrame([("cold", at(5))], "document_id string, created_at timestamp")
    got = {r.document_id: r for r in costs.merge_analysis(
        spark.createDataFrame(rows, schema), jobs).collect()}
    assert (got["up"].save_no, got["up"].tokens_in_total, got["up"].cost_usd_total) == (5, 13, 3.5)
    assert (got["cold"].triage_status, got["cold"].cost_usd_total) == ("degraded", 3.0)


def test_shared_cost_is_shown_once(spark):
    jobs = spark.createDataFrame([("a", "d", at(1), 1.0), ("b", "d", at(2), 2.0),
                                  ("c", "d", at(2), 4.0), ("z", "e", at(1), 8.0)],
                                 "id string, document_id string, created_at timestamp, "
                                 "cost_usd double")
    analyses = spark.createDataFrame([("d", 0.5), ("f", 0.25)],
                                     "document_id string, cost_usd_total double")
    rows = {r.job_id: (r.sharing_jobs, r.shown_cost_usd)
            for r in costs.attribute_shared_cost(jobs, analyses).collect()}
    assert rows == {"a": (3, None), "b": (3, 0.5), "c": (3, None), "z": (1, 0.0)}
    spent = {r.document_id: r.total_usd for r in costs.document_expense(jobs, analyses).collect()}
    assert spent == {"d": 7.5, "e": 8.0, "f": 0.25}


def test_model_comparison_keeps_the_configured_order(spark):
    usage = spark.createDataFrame([("gpt-4o", 600, 400, 2.0, True), ("gpt-4o", 0, 0, 1.0, False)],
                                  "model string, tokens_in int, tokens_out int, cost_usd double, "
                                  "bulk boolean")
    rows = costs.model_comparison(["gpt-4o-mini", "gpt-4o"], usage).collect()
    assert [(r.model, r.cost_per_million_mixed_tokens_usd, r.requests) for r in rows] == [
        ("gpt-4o-mini", None, 0), ("gpt-4o", 3000.0, 1)]
    for bad in ([], ["gpt-4o", "gpt-4o"], ["nope"], [""]):
        with pytest.raises(ValueError):
            costs.require_priced_models(bad)


def test_estimate(spark):
    frame = spark.createDataFrame(
        [("de", "en", "general", "neutral", ["ab"], [], {"ab": "ab"}, 10, 100, "gpt-4o")],
        "target_language string, source_language string, domain string, register string, "
        "terms array<string>, warnings array<string>, glossary map<string,string>, "
        "context_bytes bigint, block_bytes bigint, model string")
    row = costs.estimate_chunk_cost(frame).first()
    assert row.tokens_in == 256 + 2 + 2 + 7 + 7 + 2 + len("ab → ab".encode()) + 10 + 100
    assert row.tokens_out == 300


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "id string, job_id string, seq int, status string, "
                                       "lease_expires_at timestamp")


def test_lease_boundaries(spark):
    now = F.lit(at(1000))
    chunks = chunk_frame(spark, [("null", "j", 0, "inflight", None),
                                 ("now", "j", 1, "inflight", at(1000)),
                                 ("live", "j", 2, "inflight", at(1001)),
                                 ("edge", "j", 3, "inflight", at(880)),
                                 ("stale", "j", 4, "inflight", at(879)),
                                 ("pend", "j", 5, "pending", None)])
    released = {r.id for r in state.release_expired(chunks, now).where("released").collect()}
    assert released == {"null", "now", "edge", "stale"}
    assert [r.id for r in state.stale_inflight(chunks, now).collect()] == ["stale"]
    assert state.stale_grace_seconds(60) == 120 and state.stale_grace_seconds(90) == 180
    jobs = spark.createDataFrame([("j", "running", None), ("k", "done", None),
                                  ("l", "queued", at(1001))],
                                 "id string, status string, lease_expires_at timestamp")
    assert [r.id for r in state.eligible_jobs(jobs, now).collect()] == ["j"]
    assert [r.chunk_id for r in state.eligible_chunks(chunks, jobs, now).collect()] == ["pend"]


def test_recent_jobs(spark):
    jobs = spark.createDataFrame([("old", at(1)), ("new-b", at(9)), ("new-a", at(9)),
                                  ("middle", at(5))], "id string, created_at timestamp")
    assert [r.id for r in state.recent_jobs(jobs, 3).collect()] == ["new-a", "new-b", "middle"]
    assert state.recent_jobs(jobs, 500).count() == jobs.count()
    with pytest.raises(ValueError):
        state.recent_jobs(jobs, 0)
    with pytest.raises(ValueError):
        state.recent_jobs(jobs, True)


def test_final_status(spark):
    jobs = spark.createDataFrame([("all",), ("none",), ("gap",), ("bad",)], "id string")
    rows = [("all", True, False, False), ("all", False, True, False), ("gap", False, False, False),
            ("gap", True, False, False), ("bad", True, False, True)]
    outcomes = spark.createDataFrame(rows, "job_id string, translated boolean, passthrough boolean,"
                                           " degraded boolean")
    got = {r.job_id: r.status for r in state.final_status(jobs, outcomes).collect()}
    assert got == {"all": "done", "none": "done", "gap": "completed_with_errors",
                   "bad": "completed_with_errors"}


def test_progress_never_falls(spark):
    jobs = spark.createDataFrame([("a", "running", 5, 3), ("b", "running", 5, 3),
                                  ("c", "done", 5, 3)],
                                 "id string, status string, total_chunks int, done_chunks int")
    progress = spark.createDataFrame([("a", 9), ("b", 1), ("c", 4)], "job_id string, "
                                                                     "done_chunks int")
    got = {r.id: r.done_chunks for r in state.apply_progress(jobs, progress).collect()}
    assert got == {"a": 5, "b": 3, "c": 3}


def test_table_checks(spark):
    chunks = chunk_frame(spark, [("c", "j", 0, "done", None), ("c", "j", 1, "done", None),
                                 ("x", "gone", 0, "done", None)])
    keys = state.check_keys({"chunks": chunks}).collect()
    assert [(r.key_columns, r.key_value) for r in keys] == [("id", "c")]
    jobs = spark.createDataFrame([("j", "d", 3)], "id string, document_id string, "
                                                  "total_chunks int")
    orphans = state.check_references({"chunks": chunks, "jobs": jobs}).collect()
    assert [(r.missing_key, r.orphans) for r in orphans] == [("gone", 1)]
    links = spark.createDataFrame([("x", "b")], "chunk_id string, block_id string")
    blocks = spark.createDataFrame([("b", "d")], "id string, document_id string")
    # Chunks are read for their numbers and for their owners, not once more for their count.
    found = state.check_aggregate(jobs, chunks, links, blocks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 6
    row = state.check_aggregate(jobs, chunks, links, blocks).first()
    assert (row.chunk_difference, row.repeated_numbers, row.foreign_blocks) == (1, 0, 0)


def test_backlog_and_repair(spark):
    docs = spark.createDataFrame([("a", "extracted"), ("b", "analyzing"), ("c", "failed"),
                                  ("d", "uploaded"), ("e", "analyzing")], "id string, "
                                                                          "status string")
    analyses = spark.createDataFrame([("a", "ok"), ("b", "degraded"), ("e", "ok")],
                                     "document_id string, triage_status string")
    jobs = spark.createDataFrame([("d",)], "document_id string")
    assert {r.id for r in state.analysis_backlog(docs, analyses, jobs).collect()} == {"b"}
    fixed = {r.id: r.status for r in state.repair_stuck_status(docs, analyses, jobs).collect()}
    assert fixed["e"] == "extracted" and fixed["b"] == "analyzing"
    left = state.discard_degraded(analyses, analyses).collect()
    assert {r.document_id for r in left} == {"a", "e"}


def test_errors(spark):
    frame = spark.createDataFrame([("provider_timeout",), ("mystery",), (None,),
                                   ("render_failed",)], "error_code string")
    rows = inference.attempt_outcome(frame).collect()
    assert {(r.error_code, r.safe_code, r.outcome) for r in rows} == {
        ("provider_timeout", "provider_timeout", "retryable_error"),
        ("mystery", "internal_error", "retryable_error"), (None, None, "ok"),
        ("render_failed", "render_failed", "fatal_error")}
    assert len(schemas.ERRORS) == 23


def test_retries(spark):
    class Provider:
        def translate(self, source, language, model):
            if source == "refuse":
                raise inference.ProviderFailure("provider_refusal", 4, -1)
            if source == "crash":
                raise RuntimeError("boom")
            if source == "bad":
                return None, 1, 1
            return source.upper(), 1, 2

    units = spark.createDataFrame([("k", s, s, "de", "m") for s in ("refuse", "crash", "bad",
                                                                   "fine")],
                                  "translation_key string, source_hash string, source_text string, "
                                  "target_language string, model string")
    rows = inference.infer(units, Provider(), max_attempts=3, wait=lambda s: None).collect()
    got = {r.source_hash: (r.translated_text, r.error_code, [a.outcome for a in r.attempts])
           for r in rows}
    assert got == {
        "refuse": (None, "provider_refusal", ["fatal_error"]),
        "crash": (None, "provider_connection", ["retryable_error"] * 3),
        "bad": (None, "provider_invalid_response", ["retryable_error"] * 3),
        "fine": ("FINE", None, ["ok"])}
    assert all(0.5 * 2**i <= inference.retry_delay(i) <= min(8, 0.5 * 2**i + 0.5) or i > 3
               for i in range(6))
    assert max(inference.retry_delay(9) for _ in range(9)) == 8.0


def test_result_validation(spark):
    requests = spark.createDataFrame([("ok", "a", "m"), ("lost", "b", "m"), ("twice", "c", "m"),
                                      ("other", "d", "m"), ("bill", "e", "m")],
                                     "chunk_id string, block_id string, model string")
    results = spark.createDataFrame(
        [("ok", "a", "m", "t", 1, 1), ("twice", "c", "m", "t", 1, 1), ("twice", "c", "m", "t", 1, 1),
         ("other", "d", "n", "t", 1, 1), ("other", "x", "m", "t", 1, 1),
         ("bill", "e", "m", "t", -1, 1)],
        "chunk_id string, block_id string, model string, translated_text string, tokens_in int, "
        "tokens_out int")
    rows = {r.chunk_id: r for r in inference.validate_results(requests, results).collect()}
    assert rows["ok"].error_code is None
    assert rows["lost"].missing == rows["twice"].duplicated == rows["other"].extra == 1
    assert rows["other"].wrong_model == rows["bill"].bad_usage == 1
    assert all(r.error_code == "provider_invalid_response" for k, r in rows.items() if k != "ok")


def test_metrics_are_zero_filled(spark):
    jobs = spark.createDataFrame([], "status string, cost_usd double, cache_hit_blocks bigint, "
                                     "cache_miss_blocks bigint")
    attempts = spark.createDataFrame([("ok",)], "outcome string")
    analyses = spark.createDataFrame([], "cost_usd_total double, tokens_in_total bigint, "
                                         "tokens_out_total bigint")
    rows = state.metrics_snapshot(jobs, attempts, analyses).collect()
    assert len(rows) == 13 and all(r.value == 0 for r in rows)


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_ordered_helpers_on_one_dominant_key(spark, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < .6 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 9))
            for i in rng.sample(range(5000), 800)]
    frame = spark.createDataFrame(rows, "k string, i int, v int")
    keys, order, bucket = ["k"], [F.col("i")], ordered.span(F.col("i"), width)
    out = ordered.number_rows(frame, keys, order, bucket, "n")
    out = ordered.total_before(out, keys, order, F.col("v"), bucket, "t")
    out = ordered.previous_value(out, keys, order, F.col("v"), bucket, "p")
    out = ordered.following_value(out, keys, order, F.col("v"), bucket, "f")
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((i, v) for k, i, v in rows if k == key)
        values = [v for _, v in mine]
        for n, (i, _) in enumerate(mine):
            expected[key, i] = (n + 1, sum(values[:n]), values[n - 1] if n else None,
                                values[n + 1] if n + 1 < len(values) else None)
    assert {(r.k, r.i): (r.n, r.t, r.p, r.f) for r in out.collect()} == expected


def test_time_text(spark):
    frame = spark.createDataFrame([("2024-01-02T03:04:05.000006Z",)], "t string")
    stamp = text.parse_iso(F.col("t"))
    assert frame.select(text.iso_utc(stamp)).first()[0] == "2024-01-02T03:04:05.000006+00:00"


def test_chunk_inference_checks_answers_and_counts_attempts(spark):
    class Odd:
        calls = 0

        def translate_chunk(self, request):
            ids = [b["block_id"] for b in request["blocks_to_translate"]]
            Odd.calls += 1
            if ids[0] == "refused":
                raise inference.ProviderFailure("provider_refusal", 5, 0)
            if ids[0] == "short" and Odd.calls % 2:
                return {}, 7, 1
            return {i: request["plan"]["domain"] for i in ids}, 2, 2

    def request(chunk, left, *ids):
        payload = json.dumps({"context_before": [], "context_after": [], "blocks_to_translate": [
            {"seq": n, "block_id": i, "source_text": "t"} for n, i in enumerate(ids)]})
        return "d", chunk, "de", "m", '{"domain": "law"}', "{}", payload, left

    frame = spark.createDataFrame(
        [request(0, 3, "a", "b"), request(1, 3, "refused"), request(2, 3, "short"),
         request(3, 0, "c")],
        "document_id string, chunk_seq bigint, target_language string, model string, "
        "plan_json string, glossary_json string, payload_json string, attempts_left int").coalesce(1)
    rows = {r.chunk_seq: r for r in inference.infer_chunks(
        frame, Odd(), lambda s: None, concurrency=1).collect()}
    assert {b.block_id: b.translated_text for b in rows[0].blocks} == {"a": "law", "b": "law"}
    assert rows[1].error_code == "provider_refusal" and len(rows[1].attempts) == 1
    assert rows[3].error_code == "attempts_exhausted" and rows[3].attempts == []
    short = rows[2]
    assert short.error_code is None and short.attempts[-1].outcome == "ok"
    assert all((a.tokens_in, a.error_code) == (7, "provider_invalid_response")
               for a in short.attempts[:-1])


def test_chunk_inference_keeps_columns_beside_results(spark):
    payload = json.dumps({"context_before": [], "context_after": [], "blocks_to_translate": [
        {"seq": 0, "block_id": "a", "source_text": "t"}]})
    frame = spark.createDataFrame(
        [("d", 0, "de", "m", "{}", "{}", payload, 1, [("a", b"\x01")])],
        "document_id string, chunk_seq bigint, target_language string, model string, plan_json "
        "string, glossary_json string, payload_json string, attempts_left int, "
        "kept array<struct<block_id:string,source_hash:binary>>")
    row = inference.infer_chunks(frame, inference.PseudoChunkProvider(), lambda s: None,
                                 keep=["kept"]).first()
    assert [b.translated_text for b in row.blocks] == ["[de] t"]
    assert [(k.block_id, bytes(k.source_hash)) for k in row.kept] == [("a", b"\x01")]

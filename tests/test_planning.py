"""Planning and reuse."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import identity, text
from textloom.operators import planning, reuse


def packed(spark, sizes, budget=1000, bucket_rows=4096):
    rows = [(d, seq, f"{d}-{seq}", t) for d, ts in sizes.items() for seq, t in ts]
    frame = spark.createDataFrame(rows, "document_id string, seq int, id string, tokens int")
    out = planning.pack_chunks(frame, budget, bucket_rows).collect()
    return {(r.document_id, r.seq): (r.chunk_seq, r.seq_in_chunk) for r in out}


def greedy(sizes, budget):
    out = {}
    for d, ts in sizes.items():
        chunk, fill, place = 0, None, 0
        for seq, t in sorted(ts):
            if fill is not None and fill + t > budget:
                chunk, fill, place = chunk + 1, None, 0
            fill = (fill or 0) + t
            out[d, seq] = (chunk, place)
            place += 1
    return out


def test_greedy_packing_golden(spark):
    sizes = {"d": list(enumerate([400, 500, 200, 900, 100, 1500, 10]))}
    got = packed(spark, sizes)
    assert [got["d", i][0] for i in range(7)] == [0, 0, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("bucket_rows", [1, 3, 7, 4096])
def test_packing_in_spans_equals_one_pass(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    sizes = {}
    for d in range(60):
        seqs = sorted(rng.sample(range(90), rng.randint(1, 50)))
        top = rng.choice([3, 40, 300, 1500])
        sizes[f"doc{d}"] = [(s, rng.randint(0, top)) for s in seqs]
    sizes["hot"] = [(s, rng.randint(0, 90)) for s in range(3000)]
    assert packed(spark, sizes, 100, bucket_rows) == greedy(sizes, 100)


def test_language_lists(spark):
    rows = [(1, ["French", " french ", "de"]), (2, ["pt_BR", "-pt--br-"]), (3, [" - "]), (4, []),
            (5, None), (6, ["STRASSE_ß"])]
    frame = spark.createDataFrame(rows, "id int, target_languages array<string>")
    got = {r.id: r.languages for r in planning.normalize_requests(frame).collect()}
    assert got == {1: ["french", "de"], 2: ["pt-br"], 3: None, 4: None, 5: None, 6: ["strasse-ss"]}


def test_request_keys(spark):
    frame = spark.createDataFrame([(" k ", ["fr", "de"], "fr")],
                                  "request_key string, languages array<string>, "
                                  "target_language string")
    row = planning.request_keys(frame).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row.batch_id == f"{sha('k')}.{sha(json.dumps(['de', 'fr'], separators=(',', ':')))}"
    assert row.idempotency_key == f"{sha('k')}.{sha('k' + chr(0) + 'fr')}"


def key_of(spark, **change):
    base = {"target": "de", "model": "m", "version": "v1", "glossary": {"b": "B", "a": "Ä\"/"},
            "terms": ["x", "y"], "status": "ok"}
    values = {**base, **change}
    row = spark.createDataFrame([(values["glossary"], values["terms"])],
                                "g map<string,string>, t array<string>")
    digest = identity.plan_hash(
        source_language=F.lit("en"), domain=F.lit("general"), register=F.lit("neutral"),
        terms=F.col("t"), warnings=F.array().cast("array<string>"),
        triage_status=F.lit(values["status"]))
    return row.select(identity.translation_key(
        F.lit(values["target"]), F.lit(values["model"]), F.lit(values["version"]), F.col("g"),
        digest)).first()[0]


def test_translation_key_is_canonical_json(spark):
    def canon(v):
        return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    plan = sha(canon({"source_language": "en", "domain": "general", "register": "neutral",
                      "terms": ["x", "y"], "warnings": [], "triage_status": "ok"}))
    expected = sha(canon(["de", "m", "v1", sha(canon({"b": "B", "a": "Ä\"/"})), plan]))
    assert key_of(spark) == expected
    assert key_of(spark, glossary={"a": "Ä\"/", "b": "B"}) == expected
    changed = [key_of(spark, **c) for c in ({"target": "fr"}, {"model": "n"}, {"version": "v2"},
                                           {"glossary": {"a": "A"}}, {"terms": ["y", "x"]},
                                           {"status": "degraded"})]
    assert len({expected, *changed}) == 7


def test_idempotent_append_and_conflicts(spark):
    schema = "idempotency_key string, n int"
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], schema)
    old = spark.createDataFrame([("c", 0)], schema)
    got = planning.idempotent_append(new, old, [F.col("n")]).collect()
    assert sorted((r.idempotency_key, r.n) for r in got) == [("a", 1), ("b", 3)]
    jobs = spark.createDataFrame([("d1", "k.x"), ("d1", "k.x"), ("d2", "l.x"), ("d3", "l.x"),
                                  ("d4", "m.x"), ("d4", "m.y")], "document_id string, "
                                                                 "batch_id string")
    assert {r.request_digest for r in planning.key_conflicts(jobs).collect()} == {"l", "m"}


def test_neighbours_skip_empty_blocks(spark):
    texts = ["far", "near", "", "one", "two", "", "next"]
    blocks = spark.createDataFrame([("d", i, f"b{i}", t) for i, t in enumerate(texts)],
                                   "document_id string, seq int, id string, source_text string")
    chunk = spark.createDataFrame([("d", 3, "b3", 0), ("d", 4, "b4", 0)],
                                  "document_id string, seq int, id string, chunk_seq int")
    row = planning.neighbour_context(chunk, blocks).first()
    assert (row.before_id, row.after_id) == ("b1", "b6")


def test_requests_carry_context_and_no_metadata(spark):
    blocks = spark.createDataFrame([("d", i, f"b{i}", t) for i, t in enumerate("xyz")],
                                   "document_id string, seq int, id string, source_text string")
    missing = spark.createDataFrame([("d", 0, "de", 1, "b1", "y")],
                                    "document_id string, chunk_seq bigint, target_language string, "
                                    "seq bigint, block_id string, source_text string")
    units = spark.createDataFrame([("d", 1, "b1", 0)],
                                  "document_id string, seq int, id string, chunk_seq bigint")
    plans = spark.createDataFrame([("d", "{}", "{}")], "document_id string, plan_json string, "
                                                       "glossary_json string")
    context = planning.neighbour_context(units, blocks)
    payload = json.loads(planning.build_requests(missing, context, blocks, plans)
                         .first().payload_json)
    block = lambda s, t: [{"seq": s, "block_id": f"b{s}", "source_text": t}]
    assert payload == {"context_before": block(0, "x"), "blocks_to_translate": block(1, "y"),
                       "context_after": block(2, "z")}


def test_requests_find_texts_by_place_and_hash_in_one_exchange(spark):
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(d, i, f"{d}{i}", t) for d, i, t in (
        ("d", 0, "w"), ("d", 1, "x"), ("d", 2, "y"), ("d", 3, "z"), ("e", 0, "u"), ("e", 0, "v"))]
    blocks = spark.createDataFrame(rows, "document_id string, seq int, id string, "
                                         "source_text string")
    missing = spark.createDataFrame(
        [("d", 0, "de", 2, sha("y"), "k2"), ("d", 0, "de", 1, sha("x"), "k1"),
         ("d", 0, "fr", 1, sha("x"), "k3"), ("e", 0, "de", 0, sha("v"), "k4"),
         ("f", 0, "de", 0, sha("u"), "k5")],
        "document_id string, chunk_seq bigint, target_language string, seq bigint, "
        "source_hash binary, translation_key string")
    context = spark.createDataFrame(
        [("d", 0, 0, 3), ("e", 0, None, None)],
        "document_id string, chunk_seq bigint, before_seq bigint, after_seq bigint")
    plans = spark.createDataFrame([(d, "{}", "{}") for d in "def"],
                                  "document_id string, plan_json string, glossary_json string")
    out = planning.build_requests(missing, context, blocks, plans, keep=["translation_key"])
    # Texts, what is asked for and neighbours meet by document, where the plans come to them.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    got = {(r.document_id, r.target_language): (
        [[b["source_text"] for b in json.loads(r.payload_json)[side]]
         for side in ("context_before", "blocks_to_translate", "context_after")],
        sorted(map(tuple, r.kept))) for r in out.collect()}
    assert got == {
        ("d", "de"): ([["w"], ["x", "y"], ["z"]], [("d1", "k1"), ("d2", "k2")]),
        ("d", "fr"): ([["w"], ["x"], ["z"]], [("d1", "k3")]),
        ("e", "de"): ([[], ["v"], []], [("e0", "k4")])}


def test_neighbours_of_both_sides_share_one_exchange(spark):
    texts = ["a", "", "b", "b", "c", "", "d"]
    blocks = spark.createDataFrame(
        [(d, i, f"{d}{i}", t) for d in "xy" for i, t in enumerate(texts)],
        "document_id string, seq int, id string, source_text string")
    units = blocks.select("document_id", "seq", (F.col("seq") >= 4).cast("bigint").alias("chunk_seq"))
    out = planning.neighbour_context(units, blocks)
    # The rows of a span, its ends (twice, then beside the rows), both sides of the join, the chunks.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7
    assert {tuple(r) for r in out.collect()} == {
        (d, c, *near) for d in "xy" for c, near in enumerate(
            [(None, None, f"{d}4", 4), (f"{d}3", 3, None, None)])}


MEMORY = "translation_key string, source_hash string, translated_text string"


def test_hits_and_misses_count_every_block(spark):
    blocks = spark.createDataFrame([("j", "k", h, h) for h in "aabbc"],
                                   "job string, translation_key string, source_hash string, "
                                   "source_text string")
    memory = spark.createDataFrame([("k", "a", "A")], MEMORY)
    row = reuse.hit_miss_counts(blocks, memory, ["job"]).first()
    assert (row.hits, row.misses) == (2, 3)
    units = reuse.distinct_units(reuse.misses(blocks, memory)).collect()
    assert sorted((u.source_hash, u.blocks) for u in units) == [("b", 2), ("c", 1)]
    assert reuse.lookup(blocks, memory).where("translated_text = 'A'").count() == 2


def test_first_stored_translation_wins(spark):
    schema = MEMORY + ", created_at timestamp"
    at = [F.timestamp_seconds(F.lit(n)) for n in (5, 3, 1)]
    new = spark.createDataFrame([("k", "a", "late"), ("k", "b", "x")], MEMORY).withColumn(
        "created_at", at[0]).union(spark.createDataFrame([("k", "a", "early")], MEMORY)
                                   .withColumn("created_at", at[1]))
    old = spark.createDataFrame([("k", "b", "kept")], MEMORY).withColumn("created_at", at[2])
    got = reuse.append_first_wins(new, old).collect()
    assert [(r.source_hash, r.translated_text) for r in got] == [("a", "early")]
    assert schema


def test_hit_ratio(spark):
    frame = spark.createDataFrame([(1, 7), (0, 0), (1, 1), (2, 1)], "h int, m int")
    got = [r[0] for r in frame.select(reuse.hit_ratio(F.col("h"), F.col("m"))).collect()]
    assert got == [13, None, 50, 67]


def test_retry_plan(spark):
    jobs = spark.createDataFrame(
        [("f", "failed", None, 1.0), ("d", "done", None, 1.0), ("h", "failed", 99, 1.0),
         ("c", "completed_with_errors", 1, 9.0)],
        "id string, status string, lease int, cost_usd double").withColumn(
        "lease_expires_at", F.timestamp_seconds("lease"))
    chunks = spark.createDataFrame(
        [("f1", "f", 0, "done"), ("f2", "f", 1, "inflight"), ("c1", "c", 0, "done"),
         ("h1", "h", 0, "done")],
        "id string, job_id string, seq int, status string").withColumn(
        "lease_expires_at", F.timestamp_seconds(F.lit(5)))
    units = spark.createDataFrame([("f1", "k", "a"), ("f2", "k", "b"), ("c1", "k", "a")],
                                  "chunk_id string, translation_key string, source_hash string")
    memory = spark.createDataFrame([("k", "a", "A")], MEMORY)
    attempts = spark.createDataFrame([("f2", 1), ("f2", 3)], "chunk_id string, attempt_no int")
    now = F.timestamp_seconds(F.lit(10))
    plan = reuse.retry_plan(jobs, chunks, units, memory, attempts, now)
    assert sorted((r.chunk_id, r.status, r.baseline) for r in plan.collect()) == [
        ("c1", "done", None), ("f1", "done", None), ("f2", "pending", 3)]
    done = {r.job_id: r.done_chunks for r in reuse.retry_progress(plan).collect()}
    assert done == {"f": 1, "c": 1}
    capped = reuse.retry_plan(jobs, chunks, units, memory, attempts, now, raised_cap=6.0)
    assert {r.job_id for r in capped.collect()} == {"f"}
    for bad in (float("nan"), float("inf"), 0, -1, 5.0, True):
        with pytest.raises(ValueError):
            reuse.check_raised_cap(bad, 5.0)


def test_filenames(spark):
    names = [r"C:\fakepath\a report.pdf", "../../a report.pdf", "unsafe/name?.docx", " .. ", "é.md",
             "a" * 300 + ".pdf", ".pdf", "a..md"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in frame.select(text.sanitize_filename(F.col("n"))).collect()]
    assert got == ["a report.pdf", "a report.pdf", "name_.docx", None, "_.md",
                   "a" * 176 + ".pdf", "pdf", "a..md"]

"""Profiles, bounded looks, files and tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import profiling, segmentation
from textloom.sources import files, tables


def blocks(spark, documents):
    rows = [(d, s, t) for d, entries in documents.items() for s, t in entries]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "document_id string, seq int, source_text string")


def test_outline_keeps_both_edges(spark):
    frame = blocks(spark, {"d": [(3 * i, f"block {i}") for i in range(500)],
                           "s": [(i, "x") for i in range(60)]})
    rows = {r.document_id: r for r in profiling.document_outline(frame, edge=30).collect()}
    long, short = rows["d"], rows["s"]
    assert (long.block_count, long.first_seq, long.last_seq) == (500, 0, 1497)
    kept = [h.seq for h in long.heads]
    assert kept == [3 * i for i in [*range(30), *range(470, 500)]]
    assert len(short.heads) == 60
    whole = {r.document_id: r for r in profiling.document_outline(frame).collect()}
    assert [h.head for h in whole["d"].heads] == [f"block {i}" for i in range(500)]


def test_script_histogram(spark):
    frame = blocks(spark, {"d": enumerate(["Hello", "Привет", "مرحبا", "你好", "éß"]),
                           "cut": [(0, "x" * 500)]})
    rows = {r.document_id: r for r in profiling.script_histogram(frame).collect()}
    assert (rows["d"].latin, rows["d"].cyrillic, rows["d"].arabic, rows["d"].cjk) == (6, 6, 5, 2)
    assert rows["cut"].latin == 500
    cut = profiling.script_histogram(frame, 400).where("document_id = 'cut'").first()
    assert cut.latin == 400


def test_read_range(spark):
    frame = blocks(spark, {"d": [(10 + i, str(i)) for i in range(30)]})
    assert sorted(r.seq for r in profiling.read_range(frame, 11, 2).collect()) == [11, 12]
    assert profiling.read_range(frame, 10, 99).count() == 30
    with pytest.raises(ValueError):
        profiling.read_range(frame, 10, 0)


def test_search(spark):
    late = "x" * 3000 + "KeyWord" + "y" * 3000
    frame = blocks(spark, {"d": [(i, late) for i in range(30)], "e": [(0, "Straße")]})
    assert profiling.search_blocks(frame, ["keyword", "yyy", "no"]).count() == 60
    rows = profiling.search_blocks(frame, " keyword ", 8, 1000).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(8))
    assert all(len(r.snippet) == 1000 and "KeyWord" in r.snippet for r in rows)
    assert profiling.search_blocks(frame, "STRASSE").count() == 1
    for bad in ("", "  ", "k" * 201):
        with pytest.raises(ValueError):
            profiling.check_keyword(bad)


def test_terms(spark):
    frame = blocks(spark, {"d": [(0, "Beta Alpha Beta"), (1, "Gamma delta x2 Y3 Ünder_score Élan")],
                           "many": [(0, " ".join(f"T{'a' * i}" for i in range(40)))]})
    assert profiling.extract_terms(frame).where("document_id = 'many'").count() == 40
    rows = profiling.extract_terms(frame, 20).orderBy("document_id", "rank").collect()
    assert [r.term for r in rows if r.document_id == "d"] == ["Beta", "Alpha", "Gamma", "Élan"]
    assert len([r for r in rows if r.document_id == "many"]) == 20


def test_sample_is_cut_inside_a_block(spark):
    frame = blocks(spark, {"d": [(0, "a" * 19_998), (5000, "bcd"), (9999, "e")]})
    rows = profiling.leading_sample(frame).orderBy("seq").collect()
    assert [(r.seq, len(r.sample)) for r in rows] == [(0, 19_998), (5000, 2)]


def test_languages(spark):
    frame = blocks(spark, {"en": [(0, "Hello world")], "uk": [(0, "Привіт, світе")],
                           "ru": [(0, "Привет, мир")], "mix": [(0, "Hello everybody мир")]})
    majority = {r.document_id: r.language for r in
                profiling.detect_language_majority(frame).collect()}
    any_ = {r.document_id: r.language for r in profiling.detect_language_any(frame).collect()}
    assert majority == {"en": "en", "uk": "uk", "ru": "ru", "mix": "en"}
    assert any_ == {"en": "en", "uk": "uk", "ru": "ru", "mix": "ru"}


def test_warnings(spark):
    frame = blocks(spark, {"d": [(0, "a​\tb\n"), (1, "\U000e0101\x07漢")], "clean": [(0, "ok")]})
    plain = {r.document_id: r.code_points for r in profiling.source_warnings(frame).collect()}
    assert plain == {"d": "U+0007, U+200B, U+E0101"}
    latin = profiling.source_warnings(frame, r"\x{20}-\x{24f}").collect()
    assert [r.code_points for r in latin] == ["U+0007, U+200B, U+6F22, U+E0101"]
    stripped = profiling.strip_nonprinting(frame).orderBy("document_id", "seq").collect()
    assert [r.source_text for r in stripped] == ["ok", "a\tb\n", "漢"]


def test_bounded_payload(spark):
    rows = [(i, 'q"' + "z" * random.Random(i).randint(0, 900)) for i in range(60)]
    frame = blocks(spark, {"d": rows, "big": [(0, "x" * 20_000), (1, "y")]})
    entry = F.struct("seq", "source_text")
    got = {}
    for r in profiling.bounded_payload(frame, entry).orderBy("document_id", "payload_no").collect():
        assert r.payload_no == len(got.setdefault(r.document_id, []))
        got[r.document_id].append(json.loads(r.payload))
        assert len(r.payload) <= 16_000 or r.entries == 1
        assert r.entries == len(got[r.document_id][-1])
    items = [{"seq": s, "source_text": t} for s, t in rows]
    assert sum(got["d"], []) == items and len(got["d"]) > 1
    # A list ends only where the next entry would not fit.
    for first, second in zip(got["d"], got["d"][1:], strict=False):
        assert len(json.dumps([*first, second[0]], separators=(",", ":"))) > 16_000
    assert [len(x) for x in got["big"]] == [1, 1]


def test_files(spark, tmp_path):
    samples = {"a.md": "# é\n".encode(), "bad.md": b"\xff\xfe", "nul.md": b"a\x00b",
               "x.pdf": b"%PDF-1.7", "y.pdf": b"PK\x03\x04", "z.docx": b"PK\x03\x04..",
               "plain": b"%PDF-", "none": b"text", "tool.exe": b"MZ"}
    for name, content in samples.items():
        (tmp_path / name).write_bytes(content)
    rows = files.sniff_format(files.read_corpus(spark, str(tmp_path))).collect()
    got = {r.filename: r.format for r in rows}
    assert got == {"a.md": "md", "bad.md": None, "nul.md": None, "x.pdf": "pdf", "y.pdf": None,
                   "z.docx": "docx", "plain": "pdf", "none": None, "tool.exe": None}
    assert files.read_corpus(spark, str(tmp_path), "*.md").count() == 3


def test_admission_order(spark):
    uploads = spark.createDataFrame(
        [("ok", 10, "md", "md", None), ("huge", 50 * 2**20 + 1, "exe", None, None),
         ("exe", 1, "exe", None, None), ("broken", 1, "md", None, None),
         ("scan", 1, "pdf", "pdf", 900), ("pages", 1, "pdf", "pdf", 401),
         ("empty", 1, "md", "md", None), ("long", 1, "md", "md", None)],
        "id string, size_bytes bigint, suffix string, format string, page_count int")
    texts = spark.createDataFrame([("ok", "é"), ("scan", "  "), ("pages", "x"),
                                   ("long", "x")], "document_id string, source_text string")
    texts = texts.withColumn("source_text", F.when(F.col("document_id") == "long", F.repeat(
        F.lit("é"), 5 * 2**20 + 1)).otherwise(F.col("source_text")))
    got = {r.id: r.error_code for r in files.admit(uploads, texts).collect()}
    assert got == {"ok": None, "huge": "size_limit", "exe": "unsupported_format",
                   "broken": "corrupt_file", "scan": "scanned_pdf", "pages": "page_limit",
                   "empty": "corrupt_file", "long": "text_limit"}


def test_dedup_and_conflicts(spark):
    rows = [("b", b"same", "md"), ("a", b"same", "docx"), ("c", b"other", "md")]
    uploads = files.content_id(spark.createDataFrame(rows, "path string, content binary, "
                                                           "format string"))
    kept = files.dedup_documents(uploads, F.col("path")).collect()
    assert sorted(r.path for r in kept) == ["a", "c"]
    assert [r.uploads for r in files.format_conflicts(uploads).collect()] == [2]


def test_parallel_text(spark, tmp_path):
    (tmp_path / "en.txt").write_text("one\ntwo\n\nfour", encoding="utf-8")
    (tmp_path / "de.txt").write_text("eins\nzwei\n\nvier\n", encoding="utf-8")
    rows = files.read_text_pair(spark, str(tmp_path / "en.txt"), str(tmp_path / "de.txt"))
    got = [(r.source, r.reference) for r in rows.orderBy("position").collect()]
    assert got == [("one", "eins"), ("two", "zwei"), ("", ""), ("four", "vier")]


def test_tables(spark, tmp_path):
    docs = spark.createDataFrame([("d", "# é\n- x")], "id string, text string")
    stored = segmentation.with_metadata(segmentation.segment_markdown(docs))
    tables.append_table(stored, str(tmp_path), "blocks")
    tables.append_table(stored, str(tmp_path), "blocks")
    assert tables.read_table(spark, str(tmp_path), "blocks").count() == 4
    with pytest.raises(ValueError):
        tables.conform(docs.withColumn("surprise", F.lit(1)), "documents")


def test_outputs_are_replaced_per_job(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "job_id string, filename string, content string"
    first = [(str(i), "a.md", "v1") for i in range(200)]
    assert tables.write_outputs(spark.createDataFrame(first, schema), path).count() == 0
    again = [("3", "a.md", "v2"), ("4", "b.md", "v2"), ("new", "n.md", "v1")]
    conflicts = tables.write_outputs(spark.createDataFrame(again, schema), path).collect()
    assert [c.job_id for c in conflicts] == ["4"]
    rows = spark.read.schema(schema + ", part int").parquet(path).collect()
    got = {r.job_id: r.content for r in rows}
    assert len(rows) == 201 and got["3"] == "v2" and got["4"] == "v1" and got["new"] == "v1"


def test_case_folding_is_that_of_unicode(spark):
    changing = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000
                and len({chr(c), chr(c).lower(), chr(c).upper(), chr(c).casefold()}) > 1]
    words = ["ΟΔΟΣ", "ΟΔΟΣ ΟΔΟΣΗ", "ﬁle", "Straße", "Iı İi", "ẞ", ""]
    frame = spark.createDataFrame([(c,) for c in changing + words], "c string")
    got = frame.select("c", text.casefold(F.col("c")).alias("folded")).collect()
    assert [r for r in got if r.folded != r.c.casefold()] == []


def test_names_keep_their_suffix(spark):
    names = {"a" * 250 + "...b": ".b", "x" * 250 + ".md": ".md", "y" * 250: "", "." * 3 + "z" * 250: ""}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    for r in frame.select("n", text.sanitize_filename(F.col("n")).alias("safe")).collect():
        assert len(r.safe) <= 200 and r.safe.endswith(names[r.n])

"""Segmentation and rebuild: golden cases and a plain model on random text."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import rebuild, segmentation


def blocks_of(spark, *documents):
    docs = spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(documents)], "id string, text string"
    )
    rows = segmentation.segment_markdown(docs).orderBy("document_id", "seq").collect()
    return docs, rows


def test_empty_cells_keep_their_place(spark):
    _, rows = blocks_of(spark, "| A |  | C |\n|---|---|---|\n|  | B |  |\n")
    assert [r.line for r in rows] == [1, 1, 1, 3, 3, 3]
    assert [r.source_text for r in rows] == ["A", "", "C", "", "B", ""]
    assert [r.seq for r in rows] == list(range(6))


def test_escaped_pipe_stays_inside_its_cell(spark):
    _, rows = blocks_of(spark, r"| left \| inside | right |")
    assert [r.source_text for r in rows] == [r"left \| inside", "right"]


def test_one_pipe_is_prose_and_outer_pipes_are_a_row(spark):
    _, rows = blocks_of(spark, "yes | no\n  | a | b |  \n|\n| open")
    assert [r.kind for r in rows] == [
        "paragraph", "table_cell", "table_cell", "paragraph", "paragraph"
    ]
    assert rows[1].prefix == "  | " and rows[2].suffix == " |  "


def test_fence_needs_a_long_enough_closer(spark):
    _, rows = blocks_of(spark, "````py\ncode\n```\nstill\n````\nafter\n~~~\nopen to the end")
    assert [(r.line, r.source_text) for r in rows] == [(6, "after")]
    _, rows = blocks_of(spark, "``` a`b\nprose")
    assert [r.source_text for r in rows] == ["``` a`b", "prose"]


def test_wide_table(spark):
    rows = [["H1", "H2", "H3"], ["---"] * 3, ["a", "b", "c"], ["row 2", "", ""]]
    rows += [[f"row {n}", "", ""] for n in range(3, 12)]
    _, found = blocks_of(spark, "\n".join("|" + "|".join(r) + "|" for r in rows) + "\n")
    # 12 rows of 3 cells, without the separator; 20 of them are empty.
    assert len(found) == 36
    assert sum(not r.source_text for r in found) == 20


def test_ids_and_hashes(spark):
    _, rows = blocks_of(spark, "# One\n\n> two\n3) three\n")
    for r in rows:
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"0:{r.seq}"))
        assert r.source_hash == hashlib.sha256(r.source_text.encode()).hexdigest()
    assert [(r.kind, r.level, r.marker) for r in rows] == [
        ("heading", 1, None), ("quote", None, None), ("list_item", None, "3)")
    ]


def test_line_breaks_follow_splitlines(spark):
    samples = ["", "a", "a\n", "\n", "a\r\nb\rc\n\nd", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029", "x\r",
               "one\r\ntwo\r\n", "\r\n\r\n", "mixed\r\nlone\rend\n"]
    docs = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    got = {i: [] for i in range(len(samples))}
    rows = segmentation.explode_lines(docs).orderBy("document_id", "line").collect()
    for r in rows:
        got[r.document_id].append(r.content + r.ending)
    assert got == {i: s.splitlines(keepends=True) for i, s in enumerate(samples)}


@pytest.mark.parametrize(("document", "fenced"), [
    ("a\n```\nb\n```\nc", {2, 3, 4}), ("```\n~~~\n```\nx", {1, 2, 3}),
    ("~~~ `x`\ny\n~~~~\nz", {1, 2, 3}), ("``` `x`\ny", set()),
    ("   ```\nx\n    ```\ny\n ``` \t\nz", {1, 2, 3, 4, 5}), ("    ```\nx", set()),
    ("`````\n````\n``````\n```\nend\n", {1, 2, 3, 4, 5}), ("``\nx\n``", set()),
    ("```\nx\n``` no\ny\n", {1, 2, 3, 4}), ("```\r\nx\x0cy\u2028z\r\n```\rend", {1, 2, 3, 4, 5}),
    ("~~~\n" + "x\n" * 3000 + "~~~\ny", set(range(1, 3003))),
    ("".join(f"```{i}\nx\n```\ny\n" for i in range(300)),
     {4 * i + j for i in range(300) for j in (1, 2, 3)}),
])
def test_fenced_lines_are_emptied_in_place(spark, document, fenced):
    frame = spark.createDataFrame([(document,)], "text string")
    masked = frame.select(segmentation.mask_code_fences(F.col("text"))).first()[0]
    before, after = (text.splitlines(keepends=True) for text in (document, masked))
    assert len(before) == len(after)
    for number, (old, new) in enumerate(zip(before, after, strict=True), 1):
        stripped = old.splitlines()[0]
        assert new == (old[len(stripped):] if number in fenced else old)


PIECES = ["# ", "- ", "12. ", "> ", "|", "\\", "```", "~~~~", "---", ":--:", " ", "\t", "a", "Wort",
          "\n", "\n", "\r\n", "\x0c", "\u00a0", "`", "#", "    "]


def test_random_documents_keep_their_properties(spark):
    rng = random.Random(5)
    documents = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(400)]
    docs, rows = blocks_of(spark, *documents)
    lines = {r.document_id: {} for r in rows}
    for r in segmentation.explode_lines(docs).collect():
        lines.setdefault(r.document_id, {})[r.line] = r.content
    numbers = {}
    for r in rows:
        numbers.setdefault(r.document_id, []).append(r.seq)
        assert r.source_text == r.source_text.strip()
        assert r.source_hash == hashlib.sha256(r.source_text.encode()).hexdigest()
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.document_id}:{r.seq}"))
        if r.kind != "table_cell":
            # A prose block is its whole line; after markup, white space may lie before the text.
            line = lines[r.document_id][r.line]
            assert r.source_text and line.startswith(r.prefix) and line.endswith(r.suffix)
            assert line[len(r.prefix):].strip() == r.source_text
            if r.kind == "paragraph":
                assert r.prefix + r.source_text + r.suffix == line
        assert (r.level is not None) == (r.kind == "heading")
        assert (r.marker is not None) == (r.kind == "list_item")
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    # The cells of a row, put side by side, are the row.
    cells = {}
    for r in rows:
        if r.kind == "table_cell":
            cells.setdefault((r.document_id, r.line), []).append(r)
    assert cells
    for (document, line), row in cells.items():
        row.sort(key=lambda r: r.column)
        assert [r.column for r in row] == list(range(row[0].columns))
        assert "".join(r.prefix + r.source_text + r.suffix for r in row) == lines[document][line]
    # Prose lines and cells appear in page order.
    for document in numbers:
        own = sorted((r for r in rows if r.document_id == document), key=lambda r: r.seq)
        assert [(r.line, r.column or 0) for r in own] == sorted((r.line, r.column or 0) for r in own)


def test_numbering_of_rows_equals_numbering_in_documents(spark):
    docs, _ = blocks_of(spark, "| a | b |\nx\n# y\n" * 50, "z\n" * 10)
    whole = segmentation.segment_markdown(docs)
    again = segmentation.assign_block_ids(
        whole.select("document_id", "line", "column", "source_text")
    )
    assert whole.select("document_id", "line", "column", "seq", "id").exceptAll(
        again.select("document_id", "line", "column", "seq", "id")).count() == 0


def rebuilt(spark, document, translate):
    docs, rows = blocks_of(spark, document)
    told = [(r.document_id, r.seq, "de", translate(r)) for r in rows]
    frame = spark.createDataFrame(told, "document_id string, seq int, target string, "
                                        "translated_text string")
    blocks = segmentation.segment_markdown(docs).join(frame, ["document_id", "seq"])
    rendered = rebuild.render_blocks(blocks)
    out = rebuild.rebuild_documents(rebuild.rebuild_lines(docs, rendered, frame)).collect()
    return out[0].text


@pytest.mark.parametrize(
    ("document", "translation", "expected"),
    [
        ("|a|b|", {"a": "evil\\"}, "|evil\\\\|b|"),
        ("| left \\| in | right |", {"right": "dropping | a pipe"},
         "| left \\| in | dropping  a pipe |"),
        ("| A | B |\r\n|---|---|\r\n", {"A": "first\r\nforged | row\rend"},
         "| first forged  row end | B |\r\n|---|---|\r\n"),
        ("|a||b|\n|---|---|---|\n|x||y|", {"a": "", "b": "", "x": "", "y": "", "": "not empty"},
         "||||\n|---|---|---|\n||||"),
        ("# Title  \n\ntext\n```\ncode\n```\n- item", {"Title": "T\nU", "item": "Punkt"},
         "# T U  \n\ntext\n```\ncode\n```\n- Punkt"),
    ],
)
def test_rebuild(spark, document, translation, expected):
    assert rebuilt(spark, document, lambda r: translation.get(r.source_text)) == expected


def test_untranslated_documents_come_back_unchanged(spark):
    document = "# A\r\n\r\n| x |  | \\|y |\n|:-:|---|---|\n  > q  \nplain\x0cnext\n1) z"
    assert rebuilt(spark, document, lambda r: None) == document


def test_rebuilt_lines_and_documents_meet_once(spark):
    docs = spark.createDataFrame([("0", "# a\n\n| b | c |\n"), ("1", "d"), ("1", "d")],
                                 "id string, text string")
    pairs = [("0", "de", "k"), ("0", "uk", "l"), ("1", "uk", "l")]
    keys = spark.createDataFrame(pairs, "document_id string, target string, translation_key string")
    blocks = segmentation.segment_markdown(docs.dropDuplicates())
    memory = blocks.select(
        F.explode(F.array(F.lit("k"), F.lit("l"))).alias("translation_key"), "source_hash",
        F.concat("source_text", "source_text").alias("translated_text")).where(
        "translation_key = 'l' or source_text <> 'c'")
    carried = F.when(F.col("document_id") == "0", F.expr(
        "array(struct('de' as target, 'k' as translation_key), "
        "struct('uk' as target, 'l' as translation_key))")).otherwise(F.expr(
        "array(struct('uk' as target, 'l' as translation_key))"))
    joined = rebuild.attach_translations(blocks, keys, memory)
    own = rebuild.attach_translations(blocks.withColumn("targets", carried), None, memory)
    columns = ["document_id", "target", "translation_key", "seq", "source_text", "translated_text"]
    assert sorted(map(str, joined.select(*columns).collect())) == sorted(
        map(str, own.select(*columns).collect()))
    rendered = rebuild.render_blocks(own)
    whole = rebuild.rebuild_lines(docs, rendered, keys)
    asked = docs.withColumn("document_id", F.col("id")).withColumn("targets", carried)
    bare = rebuild.rebuild_lines(asked.drop("document_id"), rendered, None)
    assert sorted(map(str, whole.collect())) == sorted(map(str, bare.collect()))
    got = sorted((r.document_id, r.target, r.line, r.content) for r in bare.collect())
    assert got == [("0", "de", 1, "# aa"), ("0", "de", 2, ""), ("0", "de", 3, "| bb | c |"),
                   ("0", "uk", 1, "# aa"), ("0", "uk", 2, ""), ("0", "uk", 3, "| bb | cc |"),
                   ("1", "uk", 1, "dd"), ("1", "uk", 1, "dd")]
    # One exchange serves the documents with their blocks, the lines and the rebuilt texts.
    plan = rebuild.rebuild_documents(bare)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(document_id") == 1


def test_geometry_errors(spark):
    docs, _ = blocks_of(spark, "|a|b|\nprose\nmore\n")
    frame = segmentation.segment_markdown(docs)
    lines = spark.createDataFrame([("0", 3)], "document_id string, lines int")
    assert rebuild.geometry_errors(frame, lines).count() == 0
    lost = frame.where("not (column = 1) or column is null")
    assert [r.error for r in rebuild.geometry_errors(lost, lines).collect()] == ["incomplete_row"]
    moved = frame.withColumn("line", F.when(F.col("seq") == 3, 2).when(
        F.col("seq") == 0, 9).otherwise(F.col("line")))
    errors = {r.error for r in rebuild.geometry_errors(moved, lines).collect()}
    assert errors == {"line_outside_document", "incomplete_row", "several_blocks_on_line"}


def test_metadata_variant_round_trip(spark):
    docs, _ = blocks_of(spark, "## H\n- i")
    kinds = segmentation.with_metadata(segmentation.segment_markdown(docs)).select(
        F.variant_get("format_metadata", "$.kind", "string").alias("k")
    ).collect()
    assert {r.k for r in kinds} == {"heading", "list_item"}


def test_whitespace_matches_python():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}

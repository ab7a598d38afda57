"""Keyword tables, large memories and documents given as rows of lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import keywords, large_memory, line_rows, reuse, segmentation

BLOCKS = "document_id string, seq int, source_text string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# ---- keyword tables

def plain_hits(blocks, words):
    usable = {w.strip() for w in words if w and 1 <= len(w.strip()) <= 200}
    return sorted(
        (d, s, w, i + 1)
        for d, s, t in blocks if t is not None
        for w in usable
        for i in range(len(t.casefold()))
        if t.casefold().startswith(w.casefold(), i)
    )


@pytest.mark.parametrize("most_chars", [10**6, 12, 1])
def test_all_places_of_all_keywords(spark, most_chars):
    dice = random.Random(1)
    texts = ["".join(dice.choice("abAB ß") for _ in range(dice.randrange(40))) for _ in range(60)]
    blocks = [(str(i % 7), i, t) for i, t in enumerate(texts)]
    blocks += [("x", 0, None), ("x", 1, ""), ("x", 2, "Straße STRASSE aaaa" * 50)]
    words = ["a", "aa", "AA", " ab ", "ba", "B a", "ß", "strasse", "", "  ", None, "q" * 201, "zz"]
    found = keywords.search_keywords(
        spark.createDataFrame(blocks, BLOCKS).repartition(3),
        spark.createDataFrame([(w,) for w in words], "word string"), "word", most_chars)
    assert sorted(map(tuple, found.collect())) == plain_hits(blocks, words)
    assert "NestedLoop" not in plan_of(found) and "Exchange" not in plan_of(found).split(
        "MapInArrow")[0]
    rejected = keywords.rejected_keywords(
        spark.createDataFrame([(w,) for w in words], "word string"), "word")
    assert rejected.count() == 4


def test_no_keywords_and_no_blocks(spark):
    none = spark.createDataFrame([], "keyword string")
    blocks = spark.createDataFrame([("d", 0, "text")], BLOCKS)
    assert keywords.search_keywords(blocks, none).count() == 0
    word = spark.createDataFrame([("t",)], "keyword string")
    assert keywords.search_keywords(blocks.where("false"), word).count() == 0


def test_first_hits_per_document_and_keyword(spark):
    blocks = spark.createDataFrame([("d", i, "ab ab") for i in range(5)], BLOCKS)
    word = spark.createDataFrame([("AB",)], "keyword string")
    rows = keywords.first_hits(keywords.search_keywords(blocks, word), 2).collect()
    assert [(r.seq, r.position, r.places) for r in sorted(rows, key=lambda r: r.seq)] == [
        (0, 1, 2), (1, 1, 2)]


# ---- large memories

def keyed(spark, numbers, text="t"):
    return spark.createDataFrame(
        [("k", f"h{n}", f"{text}{n}") for n in numbers],
        "translation_key string, source_hash string, translated_text string")


@pytest.mark.parametrize("share", [0.1, 0.01, 0.001])
def test_filter_passes_all_keys_and_few_others(spark, share):
    passing = large_memory.key_filter(keyed(spark, range(4000)), share)
    memory = spark.range(60_000).select(
        F.lit("k").alias("translation_key"),
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("source_hash"), "id")
    kept = {r.id for r in large_memory.cut_memory(memory, passing).select("id").collect()}
    assert kept >= set(range(4000))
    assert len(kept - set(range(4000))) <= 56_000 * share * 1.5 + 10


def test_filter_bounds(spark):
    keys = keyed(spark, range(1000))
    assert large_memory.key_filter(keys, most_bytes=100) is None
    for share in (0, 1):
        with pytest.raises(ValueError):
            large_memory.key_filter(keys, share)
    nothing = large_memory.key_filter(keys.where("false"))
    assert large_memory.cut_memory(keys, nothing).count() == 0


def test_lookups_in_a_cut_memory(spark):
    blocks = keyed(spark, [1, 1, 2, 900, 901]).drop("translated_text").unionByName(
        spark.createDataFrame([(None, "h1"), ("k", None)], "translation_key string, "
                              "source_hash string"))
    memory = keyed(spark, range(500), "stored ")
    plain = sorted(map(str, reuse.lookup(blocks, memory).collect()))
    assert sorted(map(str, large_memory.lookup_cut(blocks, memory).collect())) == plain
    assert sorted(map(str, large_memory.lookup_cut(blocks, memory, most_bytes=1).collect())) == plain
    assert sorted(map(str, large_memory.misses_cut(blocks, memory).collect())) == sorted(
        map(str, reuse.misses(blocks, memory).collect()))


def test_bucketed_memory_is_not_shuffled(spark, tmp_path):
    memory = keyed(spark, range(3000), "stored ")
    stored = large_memory.write_bucketed(memory, "bucketed_test", f"file://{tmp_path}/m", 8)
    blocks = keyed(spark, [*range(0, 6000, 3)] * 2).drop("translated_text")
    found = large_memory.lookup_bucketed(blocks, stored)
    plan = plan_of(found)
    scan = next(i for i, line in enumerate(plan.splitlines()) if "bucketed_test" in line)
    above = plan.splitlines()[:scan]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not [line for line in above[join:] if "Exchange" in line], plan
    assert sorted(map(str, found.collect())) == sorted(
        map(str, reuse.lookup(blocks, memory).collect()))
    spark.sql("DROP TABLE bucketed_test")


# ---- lines as rows

PIECES = ["text", "", "  ", "```", "````", "~~~", "~~~~~", "``` sql", "```a`b", "   ```", "    ```",
          "```   ", "``", "# head", "- item", "> quote", "| a | b |", "|---|---|", "|| x\\| |",
          "12) n", "-  ", "\x0bodd"]


def some_documents(count, longest):
    dice = random.Random(9)
    # No lone carriage return: before an emptied line it would make one break of two.
    breaks = ["\n"] * 8 + ["\r\n", "\x0c", " "]
    for i in range(count):
        yield str(i), "".join(
            dice.choice(PIECES) + dice.choice(breaks) for _ in range(dice.randrange(longest)))


@pytest.mark.parametrize("width", [1, 3, 7, 4096])
def test_lines_are_masked_and_cut_as_whole_documents_are(spark, width):
    docs = spark.createDataFrame(
        [*some_documents(60, 40), ("empty", ""), ("none", None), ("open", "```\n" + "x\n" * 50)],
        "id string, text string")
    lines = segmentation.explode_lines(docs).repartition(4)
    whole = segmentation.explode_lines(
        docs.withColumn("text", segmentation.mask_code_fences(F.col("text"))))
    masked = line_rows.mask_fence_lines(lines, width)
    keep = ["document_id", "line", "content"]
    # A masked line of a rare break alone is cut again in the whole text, so blanks are left out.
    a = {tuple(r) for r in masked.select(*keep).collect() if r.content.strip()}
    b = {tuple(r) for r in whole.select(*keep).collect() if r.content.strip()}
    assert a == b and masked.columns == lines.columns and masked.count() == lines.count()
    mine, theirs = line_rows.segment_lines(lines, width=width), segmentation.segment_markdown(docs)
    assert mine.columns == theirs.columns
    assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))


def test_one_long_document_of_lines(spark):
    contents = np.where(np.arange(30_000) % 1000 == 5, "```", "plain text")
    lines = spark.createDataFrame(
        [("long", i + 1, str(c)) for i, c in enumerate(contents)],
        "document_id string, line int, content string").repartition(5)
    kept = {r.line for r in line_rows.mask_fence_lines(lines, 100).where("content != ''").collect()}
    fenced, inside = set(), False
    for i, c in enumerate(contents):
        if c == "```":
            inside = not inside
            fenced.add(i + 1)
        elif inside:
            fenced.add(i + 1)
    assert kept == set(range(1, 30_001)) - fenced

"""Translated documents from source lines, blocks and stored translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text

PROSE = ("heading", "list_item", "quote", "paragraph")
KINDS = (*PROSE, "table_cell")


def attach_translations(
    blocks: DataFrame, keys: DataFrame | None, memory: DataFrame
) -> DataFrame:
    """Blocks of every (document, target) with their translation where one is stored.

    ``keys``: document_id, target, translation_key. Without it, blocks carry them as ``targets``, an
    array of (target, translation_key), and need no join for them. A block meets the memory once for
    all its targets: stored results lie together by text, one entry per translation key.
    """
    if keys is not None:
        pairs = F.collect_list(F.struct("target", "translation_key")).alias("targets")
        blocks = blocks.join(keys.groupBy("document_id").agg(pairs), "document_id")
    known = memory.groupBy("source_hash").agg(
        F.collect_list(F.struct("translation_key", "translated_text")).alias("_known"))
    found = F.flatten(F.transform("targets", lambda t: F.transform(
        _or_nothing(F.filter("_known", lambda k: k["translation_key"] == t["translation_key"])),
        lambda k: F.struct(t["target"].alias("target"),
                           t["translation_key"].alias("translation_key"),
                           k["translated_text"].alias("translated_text")))))
    return blocks.join(known, "source_hash", "left").select(
        *[c for c in blocks.columns if c != "targets"], F.inline(found))


def _or_nothing(found: Column) -> Column:
    """Stored results of one key, or a single one without text."""
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("translation_key"),
                               F.lit(None).cast("string").alias("translated_text")))
    return F.when(F.size(found) > 0, found).otherwise(nothing)


def render_blocks(translated: DataFrame) -> DataFrame:
    """Add ``rendered`` (null keeps the source line of a prose block) and ``passthrough``."""
    cell = F.col("kind") == "table_cell"
    blank = cell & text.is_blank(F.col("source_text"))
    told = F.col("translated_text").isNotNull() & ~blank
    inner = (F.col("column") < F.col("columns") - 1) | F.contains(F.col("suffix"), F.lit("|"))
    # A source cell is written back as it is, apart from line breaks it cannot contain.
    safe = F.when(
        told, text.safe_translation(F.col("translated_text"), cell, cell & inner)
    ).otherwise(text.safe_translation(F.col("source_text"), F.lit(False), F.lit(False)))
    whole = F.concat("prefix", safe, "suffix")
    return translated.select(
        "*", F.when(cell | told, whole).alias("rendered"), blank.alias("passthrough")
    )


def rebuild_lines(
    docs: DataFrame, rendered: DataFrame, targets: DataFrame | None
) -> DataFrame:
    """(document_id, target, line, content, ending) for every line of every target.

    ``targets`` (document_id, target) says what to rebuild; without it, documents carry an array
    ``targets`` of structs with a target. Whole documents and their rendered blocks meet once, by
    document, and are cut into lines and targets only there: later steps by line or by document
    need no further exchange. Only a table row has more than one block.
    """
    names = F.array_distinct(F.col("targets")["target"])
    if targets is not None:
        wanted = targets.groupBy(F.col("document_id").alias("id")).agg(
            F.collect_set(F.struct("target")).alias("_targets"))
        docs, names = docs.join(wanted, "id"), F.col("_targets")["target"]
    line = "struct<line:int,content:string,ending:string,column:int,rendered:string>"
    nothing = F.lit(None).cast("string")
    texts = docs.select(
        F.col("id").alias("document_id"), names.alias("targets"), "text",
        F.lit(None).cast(line).alias("piece"))
    pieces = rendered.where(F.col("rendered").isNotNull()).select(
        "document_id", F.array("target").alias("targets"), nothing.alias("text"),
        F.struct("line", nothing, nothing, "column", "rendered").cast(line).alias("piece"))
    whole = F.transform(text.lines(F.col("text")), lambda x, i: F.struct(
        i + 1, x["content"], x["ending"], F.lit(None), nothing).cast(line))
    placed = texts.unionByName(pieces).where(
        F.col("document_id").isNotNull()).repartition("document_id")
    cut = placed.select("document_id", F.explode("targets").alias("target"), "text", "piece").select(
        "document_id", "target",
        F.inline(F.when(F.col("piece").isNull(), whole).otherwise(F.array("piece"))))
    source = F.when(F.col("ending").isNotNull(), F.struct("content", "ending"))
    cell = F.when(F.col("ending").isNull(), F.struct("column", "rendered"))
    per_line = cut.groupBy("document_id", "target", "line").agg(
        F.collect_list(source).alias("_source"), F.array_sort(F.collect_list(cell)).alias("_cells"))
    content = F.when(F.size("_cells") > 0, F.array_join(
        F.transform("_cells", lambda c: c["rendered"]), ""))
    # A document that is given twice has every line twice.
    return per_line.select(
        "document_id", "target", "line", content.alias("_content"), F.inline("_source")
    ).select(
        "document_id", "target", "line", F.coalesce("_content", "content").alias("content"),
        "ending",
    )


def rebuild_documents(lines: DataFrame) -> DataFrame:
    """One row per (document, target): the whole rebuilt text, which is the result itself."""
    parts = F.array_sort(
        F.collect_list(F.struct("line", F.concat("content", "ending").alias("raw")))
    )
    return lines.groupBy("document_id", "target").agg(
        F.array_join(F.transform(parts, lambda p: p["raw"]), "").alias("text")
    )


def geometry_errors(blocks: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Lines whose block metadata cannot be rebuilt.

    ``line_counts``: document_id, lines.
    """
    cell = F.col("kind") == "table_cell"
    per_line = blocks.groupBy("document_id", "line").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cell).alias("cells"),
        F.count_if(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).alias("unknown"),
        F.min("columns").alias("lo"), F.max("columns").alias("hi"),
        F.count("columns").alias("with_columns"),
        F.count_distinct(F.when(cell, F.col("column"))).alias("positions"),
        F.min("column").alias("first"), F.max("column").alias("last"),
        F.count_if(F.col("prefix").isNull() | F.col("suffix").isNull()).alias("no_affix"),
    )
    all_cells = F.col("cells") == F.col("n")
    complete = (
        (F.col("with_columns") == F.col("n")) & (F.col("lo") == F.col("hi"))
        & (F.col("lo") == F.col("n")) & (F.col("positions") == F.col("n"))
        & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    )
    error = (
        F.when(F.col("unknown") > 0, "unknown_kind")
        .when(F.col("line").isNull() | (F.col("line") < 1)
              | (F.col("line") > F.coalesce("lines", F.lit(0))), "line_outside_document")
        .when(F.col("no_affix") > 0, "missing_affix")
        .when(all_cells & ~F.coalesce(complete, F.lit(False)), "incomplete_row")
        .when(~all_cells & (F.col("n") > 1), "several_blocks_on_line")
    )
    return (
        per_line.join(line_counts, "document_id", "left")
        .select("document_id", "line", error.alias("error"))
        .where(F.col("error").isNotNull())
    )

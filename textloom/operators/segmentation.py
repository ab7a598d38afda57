"""Documents to ordered text blocks.

A document is one row, so lines, table cells and dense block numbers are all derived
inside that row and exploded once. Segmentation therefore needs no shuffle: the plan is
scan, generate, project.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import identity, text

# Markdown line syntax.
HEADING = r"(?s)^( {0,3}#{1,6}[ \t]+)"
LIST_ITEM = r"(?s)^( {0,3}(?:[-*+]|\p{Nd}++[.)])[ \t]+)"
QUOTE = r"(?s)^( {0,3}>[ \t]?)"
MARK = r"[#\-*+>\p{Nd}]"
PREFIX_ONLY = (
    r"^ {0,3}(?:#{1,6}[ \t]+|(?:[-*+]|\p{Nd}++[.)])[ \t]+|>[ \t]?)" + text.SPACE_CLASS + r"*+\z"
)
CELL = r"((?:[^|\\]++|\\[\s\S]|\\\z)*+)(?:\||\z)"
UNESCAPED_END = r"(?<!\\)(?:\\\\)*\|\z"
SEPARATOR_CELL = r"^:?-{3,}:?\z"
FENCE_HINT = r"(?:^|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]) {0,3}(?:```|~~~)"

FENCE_RUN = r"^ {0,3}(`{3,}+|~{3,}+)"
FENCE_CLOSER = r"^ {0,3}(?:`++|~++)[ \t]*+\z"
RARE_BREAK = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]\z"

_FENCE = "struct<open:string,at:int,done:int,spans:array<struct<gap:int,size:int>>>"


def fence_mark(content: Column, at: Column) -> Column:
    """What a line is to fences: (number, run, may open, may close); no run where it is nothing."""
    run = F.regexp_extract(content, FENCE_RUN, 1)
    info = F.substring(F.ltrim(content, F.lit(" ")), F.length(run) + 1, F.length(content))
    return F.struct(
        at.cast("int").alias("at"), run.alias("run"),
        (run.startswith("~") | ~F.contains(info, F.lit("`"))).alias("opens"),
        F.regexp_like(content, F.lit(FENCE_CLOSER)).alias("closes"),
    )


def _fence_marks(lines: Column) -> Column:
    """The few lines that begin with a fence run."""
    return F.filter(
        F.transform(lines, lambda line, i: fence_mark(line["content"], i)),
        lambda m: m["run"] != "")


def _fence_spans(lines: Column) -> Column:
    """Code fences of a document as (lines before it since the last fence, lines in it)."""
    def step(state: Column, mark: Column) -> Column:
        closed = state["open"] == ""
        opens = closed & mark["opens"]
        # The run of a closer is at least as long, and of the same sign.
        closes = ~closed & mark["closes"] & mark["run"].startswith(state["open"])
        span = F.struct(
            (state["at"] - state["done"]).alias("gap"),
            (mark["at"] - state["at"] + 1).alias("size"),
        )
        return F.struct(
            F.when(opens, mark["run"]).when(closes, "").otherwise(state["open"]).alias("open"),
            F.when(opens, mark["at"]).otherwise(state["at"]).alias("at"),
            F.when(closes, mark["at"] + 1).otherwise(state["done"]).alias("done"),
            F.when(closes, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            .alias("spans"),
        ).cast(_FENCE)

    def finish(state: Column) -> Column:
        rest = F.struct(
            (state["at"] - state["done"]).alias("gap"), (F.size(lines) - state["at"]).alias("size")
        )
        return F.when(state["open"] == "", state["spans"]).otherwise(
            F.concat(state["spans"], F.array(rest)))

    start = F.struct(
        F.lit("").alias("open"), F.lit(0).alias("at"), F.lit(0).alias("done"),
        F.array().cast("array<struct<gap:int,size:int>>").alias("spans"),
    ).cast(_FENCE)
    return F.aggregate(_fence_marks(lines), start, step, finish)


def _blank_fences(document: Column) -> Column:
    """The document with the lines of its code fences emptied; line breaks stay."""
    def emptied(lines: Column) -> Column:
        fenced = F.flatten(F.transform(_fence_spans(lines), lambda s: F.concat(
            F.array_repeat(F.lit(False), s["gap"]), F.array_repeat(F.lit(True), s["size"]))))
        return F.array_join(F.zip_with(lines, fenced, lambda line, inside: F.concat(
            F.when(inside, F.regexp_extract(line["content"], RARE_BREAK, 0))
            .otherwise(line["content"]), line["ending"])), "")

    return text.let(text.lines(document), emptied)


def mask_code_fences(document: Column) -> Column:
    """Text with fenced lines emptied, line numbers unchanged.

    Lines that begin like a fence are folded into spans, and the spans are laid over the lines:
    one pass inside the row. Documents without such a line are left as they are.
    """
    return F.when(
        F.regexp_like(document, F.lit(FENCE_HINT)), _blank_fences(document)
    ).otherwise(document)


def explode_lines(
    docs: DataFrame, id_col: str = "id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(document_id, line, content, ending), numbered from 1, with the ``keep`` columns."""
    numbered = docs.select(
        F.col(id_col).alias("document_id"),
        *keep,
        F.posexplode(text.lines(F.col(text_col))).alias("pos", "l"),
    )
    return numbered.select(
        "document_id",
        *keep,
        (F.col("pos") + 1).alias("line"),
        F.col("l.content").alias("content"),
        F.col("l.ending").alias("ending"),
    )


def may_be_marked(content: Column) -> Column:
    """Cheap test of the first character; most lines are prose and skip the regexes."""
    return F.regexp_like(F.substring(F.ltrim(content), 1, 1), F.lit(MARK))


def line_kind(content: Column) -> Column:
    return (
        F.when(~may_be_marked(content), "paragraph")
        .when(content.rlike(HEADING), "heading")
        .when(content.rlike(LIST_ITEM), "list_item")
        .when(content.rlike(QUOTE), "quote")
        .otherwise("paragraph")
    )


def line_prefix(content: Column) -> Column:
    """Markup before the text of a prose line."""
    marked = F.coalesce(
        *[
            F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
            for pattern in (HEADING, LIST_ITEM, QUOTE)
        ]
    )
    return F.coalesce(F.when(may_be_marked(content), marked), text.leading_space(content))


def heading_level(content: Column) -> Column:
    return F.nullif(
        F.length(F.regexp_extract(content, r"^ {0,3}(#{1,6})[ \t]", 1)), F.lit(0)
    )


def list_marker(content: Column) -> Column:
    return F.nullif(
        F.regexp_extract(content, r"^ {0,3}([-*+]|\p{Nd}++[.)])[ \t]", 1), F.lit("")
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add kind, level and marker to exploded lines."""
    content = F.col("content")
    return lines.select(
        "*",
        line_kind(content).alias("kind"),
        F.when(line_kind(content) == "heading", heading_level(content)).alias("level"),
        F.when(line_kind(content) == "list_item", list_marker(content)).alias("marker"),
    )


def split_affixes(lines: DataFrame) -> DataFrame:
    """Add prefix, source_text and suffix; the three rebuild the line of a prose block."""
    content = F.col("content")
    body = F.substring(content, F.length(F.col("prefix")) + 1, F.length(content))
    return lines.withColumn("prefix", line_prefix(content)).select(
        "*",
        text.strip(body).alias("source_text"),
        F.when(text.is_blank(body), body).otherwise(text.trailing_space(body)).alias("suffix"),
    )


def table_cells(content: Column) -> Column:
    """Raw cells of a row with both outer pipes, otherwise null."""
    inner = F.btrim(content, F.lit(" \t"))
    framed = inner.startswith("|") & F.regexp_like(inner, F.lit(UNESCAPED_END))
    inside = text.let(
        F.regexp_extract_all(inner, F.lit(CELL), F.lit(1)),
        lambda c: F.when(F.size(c) > 2, F.slice(c, F.lit(2), F.size(c) - 2)),
    )
    return F.when(framed, inside)


def _is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.regexp_like(text.strip(c), F.lit(SEPARATOR_CELL)))


def split_table_cells(lines: DataFrame) -> DataFrame:
    """One row per cell of every table row; separator rows disappear."""
    rows = lines.withColumn("_cells", table_cells(F.col("content")))
    return (
        rows.where(F.col("_cells").isNotNull() & ~_is_separator(F.col("_cells")))
        .select("*", F.size("_cells").alias("columns"),
                F.posexplode("_cells").alias("column", "cell"))
        .drop("_cells")
    )


_UNIT = "struct<line:int,raw:string,column:int,columns:int,lead:string,tail:string>"


def _unit(line: Column, raw: Column, *cell: Column) -> Column:
    column, columns, lead, tail = cell or (F.lit(None),) * 4
    return F.struct(
        line.cast("int").alias("line"), raw.alias("raw"),
        column.cast("int").alias("column"), columns.cast("int").alias("columns"),
        lead.cast("string").alias("lead"), tail.cast("string").alias("tail"),
    )


def _row_units(row: Column) -> Column:
    """Units of one table row. ``lead`` and ``tail`` hold the pipes and outer padding."""
    content, cells = row["content"], row["cells"]
    last = F.size(cells) - 1
    outer = F.regexp_extract(content, r"^[ \t]*+", 0)
    rest = F.regexp_extract(content, r"\|([ \t]*+)\z", 1)
    return F.transform(
        cells,
        lambda cell, i: _unit(
            row["line"], cell, i, F.size(cells),
            F.concat(F.when(i == 0, outer).otherwise(F.lit("")), F.lit("|")),
            F.when(i == last, F.concat(F.lit("|"), rest)).otherwise(F.lit("")),
        ),
    )


def _units(document: Column) -> Column:
    """All block candidates of one document in order, as one array."""
    parsed = F.transform(
        text.lines(document),
        lambda x, i: F.struct(
            (i + 1).alias("line"), x["content"].alias("content"),
            table_cells(x["content"]).alias("cells"),
        ),
    )
    parsed = F.filter(parsed, lambda x: ~text.is_blank(x["content"]))
    return F.flatten(F.transform(parsed, line_units))


def line_units(x: Column) -> Column:
    """Block candidates of one line that is not blank: (line, content, cells)."""
    none = F.array().cast(f"array<{_UNIT}>")
    return (
        F.when(
            x["cells"].isNotNull(),
            F.when(_is_separator(x["cells"]), none).otherwise(_row_units(x)),
        )
        .when(
            may_be_marked(x["content"]) & F.regexp_like(x["content"], F.lit(PREFIX_ONLY)), none
        )
        .otherwise(F.array(_unit(x["line"], x["content"])))
    )


def block_columns(keep: Sequence[str]) -> tuple[list, list]:
    """Two projections from (document_id, seq, u) and the ``keep`` columns to blocks."""
    raw, is_cell = F.col("u.raw"), F.col("u.column").isNotNull()
    blank_cell = is_cell & text.is_blank(raw)
    shaped = [
        "document_id",
        *keep,
        "seq",
        F.col("u.line").alias("line"),
        F.when(is_cell, "table_cell").otherwise(line_kind(raw)).alias("kind"),
        raw.alias("raw"),
        F.when(
            is_cell,
            F.concat(
                F.col("u.lead"),
                F.when(blank_cell, raw).otherwise(text.leading_space(raw)),
            ),
        ).otherwise(line_prefix(raw)).alias("prefix"),
        F.when(is_cell, raw)
        .otherwise(F.substring(raw, F.length(line_prefix(raw)) + 1, F.length(raw)))
        .alias("body"),
        F.col("u.column").alias("column"),
        F.col("u.columns").alias("columns"),
        F.coalesce(F.col("u.tail"), F.lit("")).alias("tail"),
    ]
    kind, body = F.col("kind"), F.col("body")
    blocks = [
        "document_id",
        *keep,
        "seq",
        identity.block_id(F.col("document_id"), F.col("seq")).alias("id"),
        text.strip(body).alias("source_text"),
        identity.sha256(text.strip(body)).alias("source_hash"),
        "kind",
        "line",
        F.when(kind == "heading", heading_level(F.col("raw"))).alias("level"),
        F.when(kind == "list_item", list_marker(F.col("raw"))).alias("marker"),
        "column",
        "columns",
        "prefix",
        F.concat(
            F.when(text.is_blank(body), "").otherwise(text.trailing_space(body)), F.col("tail")
        ).alias("suffix"),
    ]
    return shaped, blocks


def segment_markdown(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    fences: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Blocks of Markdown documents with ids, hashes and rebuild metadata.

    ``keep`` names document columns to carry to every block, which saves a join later.
    """
    document = F.col(text_col)
    # Fences are folded once: the units use their argument several times.
    found = text.let(mask_code_fences(document), _units) if fences else _units(document)
    shaped, blocks = block_columns(keep)
    return docs.select(
        F.col(id_col).alias("document_id"), *keep, F.posexplode(found).alias("seq", "u"),
    ).select(*shaped).select(*blocks)


def assign_block_ids(units: DataFrame) -> DataFrame:
    """Number units given as rows (document_id, line, column, source_text).

    For text that does not sit in one row per document. Numbering goes through line
    buckets, so one long document is spread over many tasks.
    """
    from textloom.functions.ordered import number_rows, span

    numbered = number_rows(
        units, ["document_id"], [F.col("line"), F.col("column")], span(F.col("line"), 4096),
        "seq", start=0,
    )
    return numbered.select(
        "*",
        identity.block_id(F.col("document_id"), F.col("seq")).alias("id"),
        identity.sha256(F.col("source_text")).alias("source_hash"),
    )


def with_metadata(blocks: DataFrame) -> DataFrame:
    """Fold the Markdown columns into one opaque variant, as the blocks table stores it."""
    fields = F.struct("kind", "line", "level", "marker", "column", "columns", "prefix", "suffix")
    return blocks.select(
        "id", "document_id", "seq", "source_text", "source_hash",
        F.parse_json(F.to_json(fields)).alias("format_metadata"),
    )


def is_structural(kind: Column, source_text: Column) -> Column:
    """Blank table cells: kept for the rebuild, never planned."""
    return (kind == "table_cell") & text.is_blank(source_text)


def structural_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(is_structural(F.col("kind"), F.col("source_text")))


def drop_empty_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_structural(F.col("kind"), F.col("source_text")))


def document_summary(docs: DataFrame, blocks: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents with block count and, where present, their analysis."""
    counts = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("block_count"))
    return (
        docs.join(counts.withColumnRenamed("document_id", "id"), "id", "left")
        .join(analyses.withColumnRenamed("document_id", "id"), "id", "left")
        .withColumn("block_count", F.coalesce("block_count", F.lit(0)).cast("bigint"))
    )


def blocks_of(blocks: DataFrame, document_id: str) -> DataFrame:
    return blocks.where(F.col("document_id") == document_id).orderBy("seq")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Document text as block texts in order; one row per document is the result itself."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "source_text")))
    return blocks.groupBy("document_id").agg(
        F.array_join(F.transform(parts, lambda p: p["source_text"]), "\n").alias("text")
    )

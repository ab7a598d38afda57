"""Segmentation of documents that arrive as rows of lines, for texts too long for one row.

Whether a line lies in a code fence depends on all lines before it. The lines of a document are cut
into spans of their numbers. Each span states how it would be left for every way of entering it: a
function from the open fence before it to the open fence after it, which needs few entries, as only
a longer closing run than all before it makes a difference. The small functions of a document are
applied in order, and then every span is masked by itself.

Only lines that begin with a fence run take part in this; all others are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.functions.ordered import number_rows, span
from textloom.operators import segmentation

#: Lines per span.
WIDTH = 4096

_PASSED = "array<struct<span:bigint,enter:string,leave:string>>"
_OPEN = "struct<open:string,at:bigint,parts:array<struct<first:bigint,last:bigint>>>"


def _closes(mark: Column, open_: Column) -> Column:
    """The run of a closer is at least as long, and of the same sign."""
    return (open_ != "") & mark["closes"] & mark["run"].startswith(open_)


def _after(open_: Column, mark: Column) -> Column:
    """The open fence after a mark; empty where there is none."""
    return (
        F.when((open_ == "") & mark["opens"], mark["run"])
        .when(_closes(mark, open_), "").otherwise(open_)
    )


def _leaves(marks: Column) -> tuple[Column, Column]:
    """A span's function: the open fence after it if none was open before, and otherwise, by the
    run that closes the first one, what is open at its end."""
    after_none = F.aggregate(marks, F.lit(""), _after)

    def closer(mark: Column, i: Column) -> Column:
        # A run that an earlier closer's run begins with never closes first.
        earlier = F.exists(F.slice(marks, F.lit(1), i), lambda m: m["closes"] & m["run"].startswith(
            mark["run"]))
        rest = F.slice(marks, i + 2, F.size(marks))
        return F.when(mark["closes"] & ~earlier, F.struct(
            mark["run"].alias("run"), F.aggregate(rest, F.lit(""), _after).alias("leave")))

    return after_none, F.filter(F.transform(marks, closer), lambda c: c.isNotNull())


def _walked(spans: Column) -> Column:
    """Spans of one document, in order, with the open fence before and after each."""
    def step(done: Column, s: Column) -> Column:
        enter = F.when(F.size(done) > 0, F.element_at(done, -1)["leave"]).otherwise("")
        first = F.filter(s["closers"], lambda c: c["run"].startswith(enter))
        leave = (
            F.when(enter == "", s["after_none"])
            .when(F.size(first) > 0, first[0]["leave"]).otherwise(enter)
        )
        return F.concat(done, F.array(F.struct(
            s["span"].alias("span"), enter.alias("enter"), leave.alias("leave"))))

    return F.aggregate(spans, F.array().cast(_PASSED), step)


def _fenced_parts(marks: Column, enter: Column, first: Column, last: Column) -> Column:
    """The fenced stretches of a span as (first, last) line."""
    def part(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.cast("bigint").alias("first"), b.cast("bigint").alias("last")))

    def step(state: Column, mark: Column) -> Column:
        return F.struct(
            _after(state["open"], mark).alias("open"),
            F.when((state["open"] == "") & mark["opens"], mark["at"].cast("bigint"))
            .otherwise(state["at"]).alias("at"),
            F.when(_closes(mark, state["open"]),
                   F.concat(state["parts"], part(state["at"], mark["at"])))
            .otherwise(state["parts"]).alias("parts"),
        ).cast(_OPEN)

    start = F.struct(
        enter.alias("open"), first.cast("bigint").alias("at"),
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("parts")).cast(_OPEN)
    return F.aggregate(marks, start, step, lambda s: F.when(
        s["open"] == "", s["parts"]).otherwise(F.concat(s["parts"], part(s["at"], last))))


def fenced_spans(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """(document_id, span, parts): the fenced stretches of every span that has some."""
    mark = segmentation.fence_mark(F.col("content"), F.col("line"))
    marks = (
        lines.where(F.regexp_like("content", F.lit(segmentation.FENCE_RUN)))
        .select("document_id", span(F.col("line"), width).alias("span"), mark.alias("m"))
        .groupBy("document_id", "span").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    )
    after_none, closers = _leaves(F.col("marks"))
    walked = marks.groupBy("document_id").agg(_walked(F.array_sort(F.collect_list(F.struct(
        "span", after_none.alias("after_none"), closers.alias("closers"))))).alias("w"))
    ends = lines.groupBy("document_id").agg(span(F.max("line"), width).alias("_last"))
    passed = (
        walked.select("document_id", F.inline("w"))
        .withColumn("next", F.lead("span").over(
            Window.partitionBy("document_id").orderBy("span")))
    )
    own = passed.join(marks, ["document_id", "span"]).select(
        "document_id", "span", _fenced_parts(
            F.col("marks"), F.col("enter"), F.col("span") * width,
            F.col("span") * width + width - 1).alias("parts"))
    # Spans without a mark behind one that was left open are fenced as a whole.
    between = (
        passed.where("leave != ''").join(ends, "document_id")
        .withColumn("to", F.coalesce(F.col("next") - 1, "_last"))
        .where(F.col("to") > F.col("span"))
        .select("document_id", F.explode(F.sequence(F.col("span") + 1, F.col("to"))).alias("span"))
        .select("document_id", "span", F.array(F.struct(
            (F.col("span") * width).alias("first"),
            (F.col("span") * width + width - 1).alias("last"))).alias("parts"))
    )
    return own.where(F.size("parts") > 0).unionByName(between)


def mask_fence_lines(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """``lines`` (document_id, line, content, ..) with fenced contents emptied.

    Equals `segmentation.mask_code_fences` of the whole document. Line numbers may have gaps, but
    must not repeat within a document; a null content is no fence and stays.
    """
    parts = fenced_spans(lines, width).withColumnRenamed("parts", "_parts")
    joined = lines.withColumn("span", span(F.col("line"), width)).join(
        parts, ["document_id", "span"], "left")
    inside = F.coalesce(F.exists("_parts", lambda p: F.col("line").between(
        p["first"], p["last"])), F.lit(False))
    emptied = F.regexp_extract("content", segmentation.RARE_BREAK, 0)
    return joined.withColumn(
        "content", F.when(inside, emptied).otherwise(F.col("content"))).select(*lines.columns)


def segment_lines(
    lines: DataFrame, fences: bool = True, keep: Sequence[str] = (), width: int = WIDTH
) -> DataFrame:
    """Blocks of Markdown documents given as lines, as `segmentation.segment_markdown` cuts them.

    Blocks are numbered through spans of lines, so one long document is spread over tasks.
    """
    masked = mask_fence_lines(lines, width) if fences else lines
    row = F.struct("line", "content", segmentation.table_cells(F.col("content")).alias("cells"))
    units = masked.where(~text.is_blank(F.col("content"))).select(
        "document_id", *keep, F.explode(text.let(row, segmentation.line_units)).alias("u"))
    numbered = number_rows(
        units, ["document_id"], [F.col("u.line"), F.coalesce(F.col("u.column"), F.lit(0))],
        span(F.col("u.line"), width), "seq", start=0)
    shaped, blocks = segmentation.block_columns(keep)
    return numbered.withColumn("seq", F.col("seq").cast("int")).select(*shaped).select(*blocks)

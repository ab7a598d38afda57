"""Profiles of documents and bounded looks into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import text
from textloom.functions.ordered import span, top_per_key, total_before

# The size of the usual sample and the longest keyword.
SAMPLE_CHARS = 20_000
MAX_KEYWORD = 200
# Letters of Ukrainian that Russian lacks.
UKRAINIAN = "іїєґІЇЄҐ"

LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"(?<!{text.WORD_CLASS}){LETTER}++(?!{text.WORD_CLASS})"
CAPITALISED = r"^\p{IsUppercase}"

DOC = ["document_id"]
_SPAN_ROWS = 4096


def strip_nonprinting(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("source_text", text.strip_nonprinting(F.col("source_text")))


def source_warnings(blocks: DataFrame, supported: str | None = None) -> DataFrame:
    """Sorted distinct offending code points per document.

    Non-printing characters always count. ``supported`` is a regex class of printable
    characters; visible characters outside it count too.
    """
    offending = text.NONPRINTING
    if supported is not None:
        offending = rf"{offending}|(?!{text.SPACE_CLASS})[^{supported}]"
    hits = F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("source_text"), F.lit(offending), F.lit(0))
    ))
    chars = blocks.select("document_id", hits.alias("char")).distinct()
    points = F.transform(
        F.array_sort(F.collect_list(F.struct(F.ascii("char").alias("code"), "char"))),
        lambda c: text.code_point_label(c["char"]),
    )
    # At most one entry per Unicode code point.
    return chars.groupBy("document_id").agg(F.array_join(points, ", ").alias("code_points"))


def _first(column: str, chars: int | None) -> Column:
    """The first ``chars`` characters of a column, or all of it."""
    return F.col(column) if chars is None else F.substring(column, 1, chars)


def _script_counts(value: Column) -> list[Column]:
    return [
        F.sum(text.count_class(value, text.SCRIPT_CLASSES[s])).alias(s) for s in schemas.SCRIPTS
    ]


def script_histogram(blocks: DataFrame, chars: int | None = None) -> DataFrame:
    """Characters per script; ``chars`` looks at the beginning of each block only."""
    return blocks.groupBy("document_id").agg(*_script_counts(_first("source_text", chars)))


def detect_language_majority(
    blocks: DataFrame, first_blocks: int | None = None, chars: int | None = None
) -> DataFrame:
    """uk or ru when Cyrillic outnumbers Latin, otherwise en.

    Counts whole documents unless told to look at the first blocks or characters only.
    """
    sample = blocks.select("document_id", "seq", _first("source_text", chars).alias("t"))
    if first_blocks is not None:
        sample = top_per_key(sample, DOC, [F.col("seq")], first_blocks)
    sums = sample.groupBy("document_id").agg(
        F.sum(text.count_class(F.col("t"), text.SCRIPT_CLASSES["cyrillic"])).alias("cyrillic"),
        F.sum(text.count_class(F.col("t"), text.SCRIPT_CLASSES["latin"])).alias("latin"),
        F.bool_or(F.col("t").rlike(f"[{UKRAINIAN}]")).alias("marked"),
    )
    return sums.select(
        "document_id",
        F.when(F.col("cyrillic") <= F.col("latin"), "en").when(F.col("marked"), "uk")
        .otherwise("ru").alias("language"),
    )


def leading_sample(blocks: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The first characters of every document, cut inside the block that crosses the limit."""
    sized = total_before(
        blocks.select("document_id", F.col("seq").cast("bigint").alias("seq"), "source_text"),
        DOC, [F.col("seq")], F.length("source_text"), span(F.col("seq"), _SPAN_ROWS), "start",
    )
    return sized.where(F.col("start") < chars).select(
        "document_id", "seq",
        F.substring(F.col("source_text"), F.lit(1), (F.lit(chars) - F.col("start")).cast("int"))
        .alias("sample"),
    )


def _sampled(blocks: DataFrame, chars: int | None) -> DataFrame:
    if chars is not None:
        return leading_sample(blocks, chars)
    return blocks.select("document_id", "seq", F.col("source_text").alias("sample"))


def detect_language_any(blocks: DataFrame, chars: int | None = None) -> DataFrame:
    """uk or ru when the document (or its leading sample) holds any Cyrillic letter, else en."""
    sums = _sampled(blocks, chars).groupBy("document_id").agg(
        F.bool_or(F.col("sample").rlike(f"[{text.SCRIPT_CLASSES['cyrillic']}]")).alias("any"),
        F.bool_or(F.col("sample").rlike(f"[{UKRAINIAN}]")).alias("marked"),
    )
    return sums.select(
        "document_id",
        F.when(~F.col("any"), "en").when(F.col("marked"), "uk").otherwise("ru").alias("language"),
    )


def extract_terms(
    blocks: DataFrame, k: int | None = None, chars: int | None = None
) -> DataFrame:
    """Distinct capitalised words by first appearance: (document_id, rank, term).

    All of the whole document, unless limited to ``k`` terms or to a leading sample.
    """
    words = _sampled(blocks, chars).select(
        "document_id", "seq",
        F.posexplode(F.regexp_extract_all("sample", F.lit(WORD), F.lit(0))).alias("at", "term"),
    ).where(F.col("term").rlike(CAPITALISED))
    first = words.groupBy("document_id", "term").agg(
        F.min(F.struct("seq", "at")).alias("place")
    )
    order = Window.partitionBy("document_id").orderBy("place")
    ranked = first.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("document_id", "rank", "term")


def document_outline(
    blocks: DataFrame, edge: int | None = None, head_chars: int | None = None
) -> DataFrame:
    """Block count, sequence ends, script counts and block heads of every document, in one pass.

    ``edge`` keeps the heads of the first and last blocks only, ``head_chars`` their beginning.
    """
    head = F.struct("seq", _first("source_text", head_chars).alias("head"))
    if edge is not None:
        last = Window.partitionBy("document_id")
        place = F.row_number().over(last.orderBy(F.asc("seq")))
        back = F.row_number().over(last.orderBy(F.desc("seq")))
        blocks = blocks.withColumn("_outer", (place <= edge) | (back <= edge))
        head = F.when(F.col("_outer"), head)
    return blocks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("block_count"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), *_script_counts(F.col("source_text")),
        F.array_sort(F.collect_list(head)).alias("heads"),
    )


def read_range(
    blocks: DataFrame, start: int, count: int, chars: int | None = None
) -> DataFrame:
    """Texts of ``count`` consecutive blocks of every document, or their beginnings."""
    if count < 1:
        raise ValueError(f"a range holds at least one block, not {count}")
    seq = F.col("seq")
    return blocks.where((seq >= start) & (seq < start + count)).select(
        "document_id", "seq", _first("source_text", chars).alias("snippet")
    )


def check_keyword(keyword: str) -> str:
    trimmed = keyword.strip()
    if not 1 <= len(trimmed) <= MAX_KEYWORD:
        raise ValueError(f"a keyword has 1 to {MAX_KEYWORD} characters besides white space")
    return trimmed


def search_blocks(
    blocks: DataFrame, keywords: str | Sequence[str], k: int | None = None,
    chars: int | None = None,
) -> DataFrame:
    """Blocks that hold a keyword, letter case aside: (document_id, seq, keyword, snippet).

    A block has one row per keyword found in it. ``chars`` cuts the snippet around the match,
    ``k`` keeps the first rows of every document and keyword; without them nothing is left out.
    """
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    words = list(dict.fromkeys(check_keyword(w) for w in words))
    folded = text.casefold(F.col("source_text"))
    looked_for = F.array(*[
        F.struct(F.lit(w).alias("keyword"), F.instr(folded, text.casefold(F.lit(w))).alias("at"))
        for w in words
    ])
    found = blocks.select(
        "document_id", "seq", "source_text",
        F.inline(F.filter(looked_for, lambda x: x["at"] > 0)),
    )
    snippet = F.col("source_text")
    if chars is not None:
        start = F.greatest(F.lit(1), F.col("at") - chars // 4)
        snippet = F.substring(snippet, start, F.lit(chars))
    hits = found.select("document_id", "seq", "keyword", snippet.alias("snippet"))
    return hits if k is None else top_per_key(hits, ["document_id", "keyword"], [F.col("seq")], k)


def bounded_payload(rows: DataFrame, entry: Column, limit: int = 16_000) -> DataFrame:
    """Compact JSON lists of at most ``limit`` characters: (document_id, payload_no, entries,
    payload).

    What does not fit into the first list goes on in further ones; a single entry that is longer
    than the limit has a list of its own. ``rows`` has document_id, seq (from 0, without gaps) and
    the columns of ``entry``.
    """
    from textloom.operators.planning import pack_chunks

    encoded = rows.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.to_json(entry, {"ignoreNullFields": "false"}).alias("json"),
    )
    # n entries take their own lengths, n - 1 commas and 2 brackets. Only lengths are packed.
    sizes = encoded.select(
        "document_id", "seq", F.lit("").alias("id"), (F.length("json") + 1).alias("tokens"))
    places = pack_chunks(sizes, budget=limit - 1).select("document_id", "seq", "chunk_seq")
    packed = encoded.join(places, ["document_id", "seq"])
    lists = packed.groupBy("document_id", F.col("chunk_seq").alias("payload_no")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.array_sort(F.collect_list(F.struct("seq", "json"))).alias("parts"),
    )
    return lists.select(
        "document_id", "payload_no", "entries",
        F.concat(
            F.lit("["), F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit("]"),
        ).alias("payload"),
    )

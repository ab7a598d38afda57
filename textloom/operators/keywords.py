"""Search for a whole table of keywords at once.

Keywords become an automaton that finds all of them in one pass over a text, however many there
are. The table's size is counted first; beyond ``most_chars`` characters it is cut into parts by a
hash of the keyword, one automaton each, so a broadcast never exceeds its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators.profiling import MAX_KEYWORD


def usable_keywords(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """(keyword, folded): distinct trimmed keywords of 1 to ``MAX_KEYWORD`` characters."""
    trimmed = text.strip(F.col(f"`{column}`"))
    return keywords.select(trimmed.alias("keyword")).where(
        F.length("keyword").between(1, MAX_KEYWORD)
    ).distinct().withColumn("folded", text.casefold(F.col("keyword")))


def rejected_keywords(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """Rows of ``keywords`` that are null, blank or too long and so match nothing."""
    size = F.length(text.strip(F.col(f"`{column}`")))
    return keywords.where(~F.coalesce(size.between(1, MAX_KEYWORD), F.lit(False)))


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value:  # an empty part of the table
            return
        import ahocorasick

        automaton, names = ahocorasick.Automaton(), []
        for folded, originals in shared.value:
            automaton.add_word(folded, (len(folded), len(names)))
            names.append(originals)
        automaton.make_automaton()
        for batch in batches:
            rows, at, found = [], [], []
            for i, content in enumerate(batch.column("_folded").to_pylist()):
                for end, (size, which) in automaton.iter(content or ""):
                    for original in names[which]:
                        rows.append(i)
                        at.append(end - size + 2)
                        found.append(original)
            kept = batch.drop_columns(["_folded"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [*kept.columns, pa.array(found, pa.string()), pa.array(at, pa.int64())],
                names=[*kept.schema.names, "keyword", "position"])
    return run


def search_keywords(
    blocks: DataFrame, keywords: DataFrame, column: str = "keyword",
    most_chars: int = 1_000_000,
) -> DataFrame:
    """All places of all keywords, letter case aside: (document_id, seq, keyword, position).

    ``blocks`` has document_id, seq and source_text; ``position`` counts the characters of the
    case-folded text from 1, and places may overlap. Keywords that are equal when trimmed count
    once; `rejected_keywords` names those that cannot be looked for. Null texts hold none. No text
    is shuffled.
    """
    spark = blocks.sparkSession
    usable = usable_keywords(keywords, column)
    folded = usable.groupBy("folded").agg(F.array_sort(F.collect_set("keyword")).alias("names"))
    total = usable.agg(F.sum(F.length("folded") + F.length("keyword"))).first()[0] or 0
    parts = max(1, -(-total // most_chars))
    texts = blocks.select(
        "document_id", "seq", text.casefold(F.col("source_text")).alias("_folded"))
    schema = texts.drop("_folded").schema.add("keyword", "string").add("position", "long")
    hits = []
    for part in range(parts):
        own = folded if parts == 1 else folded.where(
            F.pmod(F.xxhash64("folded"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in own.collect()])
        hits.append(texts.mapInArrow(_find(shared), schema))
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def first_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` blocks of every document and keyword, each with its first position."""
    from textloom.functions.ordered import top_per_key

    blocks = hits.groupBy("document_id", "keyword", "seq").agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("places"))
    return top_per_key(blocks, ["document_id", "keyword"], [F.col("seq")], k)

"""Which blocks an edit kept, moved, changed, added and deleted.

Blocks that occur once in both versions of a document anchor them to each other: the longest
sequence of anchors in the same order stays put, and cuts both versions into gaps. What is left is
compared gap by gap, so a long document is compared in small pieces.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ordered import number_rows, span, total_before
from textloom.session import shared_folder

#: Table cells up to which a gap is compared in full.
FULL = 4_000_000
_WIDTH = 4096
_PAIR = "document_id string, old_seq bigint, new_seq bigint"


def longest_rising(values: Sequence[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            ends.append(i)
        else:
            tops[at], ends[at] = value, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common_in_order(old: Sequence[str], new: Sequence[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence.

    Gaps beyond ``FULL`` cells pair the occurrences of each text one by one and keep the longest
    rising sequence of these pairs: in order as well, but not always the longest.
    """
    start = 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    end = 0
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[start:len(old) - end], new[start:len(new) - end]
    if len(a) * len(b) <= FULL:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            row, under = best[i], best[i + 1]
            for j in range(len(b) - 1, -1, -1):
                row[j] = under[j + 1] + 1 if a[i] == b[j] else max(under[j], row[j + 1])
        inner, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places = defaultdict(list)
        for j in range(len(b) - 1, -1, -1):
            places[b[j]].append(j)
        pairs = [(i, places[x].pop()) for i, x in enumerate(a) if places.get(x)]
        inner = [pairs[k] for k in longest_rising([j for _, j in pairs])]
    head = [(i, i) for i in range(start)]
    tail = [(len(old) - k, len(new) - k) for k in range(end, 0, -1)]
    return head + [(start + i, start + j) for i, j in inner] + tail


def _rising(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for document, old, new in zip(*(frame[c] for c in ("document_id", "old", "new")), strict=True):
            rows += [(document, old[i], new[i]) for i in longest_rising(list(new))]
        yield pd.DataFrame(rows, columns=["document_id", "old_seq", "new_seq"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once, as several later steps read it."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gap_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for document, old, old_at, new, new_at in zip(
            *(frame[c] for c in ("document_id", "old", "old_at", "new", "new_at")), strict=True
        ):
            rows += [(document, old_at[i], new_at[j])
                     for i, j in common_in_order(list(old), list(new))]
        yield pd.DataFrame(rows, columns=["document_id", "old_seq", "new_seq"])


def _with_gap(blocks: DataFrame, anchors: DataFrame, side: str) -> DataFrame:
    """``blocks`` that are no anchors, with the number of anchors before them."""
    marked = blocks.join(
        anchors.select("document_id", F.col(side).alias("seq"), F.lit(1).alias("anchor")),
        ["document_id", "seq"], "left")
    counted = total_before(
        marked, ["document_id"], [F.col("seq")], F.coalesce("anchor", F.lit(0)),
        span(F.col("seq"), _WIDTH), "gap")
    return counted.where("anchor IS NULL").drop("anchor")


def _unmatched(rest: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rest.join(
        pairs.select("document_id", F.col(side).alias("seq")), ["document_id", "seq"], "left_anti")


def _numbered(rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    return number_rows(rest, keys, [F.col("seq")], span(F.col("seq"), _WIDTH), "nth")


def block_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, change, old_seq, new_seq) of every block of two versions of documents.

    Both have document_id, seq and source_hash; a seq must not repeat in a document. ``kept`` is in
    the same order in both versions, ``moved`` has the same text elsewhere, ``edited`` replaces a
    block between the same kept neighbours, ``added`` and ``deleted`` are on one side only (the
    other seq is null). The blocks of one gap, and the narrow rows (two numbers) of one document's
    anchors, meet in one task.
    """
    old = before.select("document_id", F.col("seq").cast("bigint").alias("seq"), "source_hash")
    new = after.select("document_id", F.col("seq").cast("bigint").alias("seq"), "source_hash")

    def once(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.groupBy("document_id", "source_hash").agg(
            F.count(F.lit(1)).alias("n"), F.min("seq").alias(name)).where("n = 1").drop("n")

    single = once(old, "old_seq").join(once(new, "new_seq"), ["document_id", "source_hash"])
    in_order = F.array_sort(F.collect_list(F.struct("old_seq", "new_seq")))
    anchors = _stored(single.groupBy("document_id").agg(in_order.alias("a")).select(
        "document_id", F.col("a.old_seq").alias("old"), F.col("a.new_seq").alias("new"),
    ).mapInPandas(_rising, _PAIR), "anchors")
    old_rest = _stored(_with_gap(old, anchors, "old_seq"), "old")
    new_rest = _stored(_with_gap(new, anchors, "new_seq"), "new")

    # Only texts that both sides of a gap have can be kept in it.
    gap = ["document_id", "gap"]
    shared = old_rest.select(*gap, "source_hash").intersect(new_rest.select(*gap, "source_hash"))

    def gathered(rest: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("seq", "source_hash")))
        return rest.join(shared, [*gap, "source_hash"], "left_semi").groupBy(*gap).agg(
            rows.alias("r")).select(
                *gap, F.transform("r", lambda x: x["source_hash"]).alias(name),
                F.transform("r", lambda x: x["seq"]).alias(f"{name}_at"))

    inside = _stored(gathered(old_rest, "old").join(gathered(new_rest, "new"), gap).mapInPandas(
        _gap_pairs, _PAIR), "inside")
    kept = anchors.unionByName(inside)

    def rest_of(rest: DataFrame, side: str) -> DataFrame:
        return _unmatched(rest, inside, side)

    by_text = ["document_id", "source_hash"]
    moved = _stored(
        _numbered(rest_of(old_rest, "old_seq"), by_text)
        .select(*by_text, "nth", F.col("seq").alias("old_seq"))
        .join(_numbered(rest_of(new_rest, "new_seq"), by_text)
              .select(*by_text, "nth", F.col("seq").alias("new_seq")), [*by_text, "nth"])
        .select("document_id", "old_seq", "new_seq"), "moved")

    def left_over(rest: DataFrame, side: str) -> DataFrame:
        return _numbered(_unmatched(rest_of(rest, side), moved, side), gap).select(
            *gap, "nth", F.col("seq").alias(side))

    edited = left_over(old_rest, "old_seq").join(
        left_over(new_rest, "new_seq"), [*gap, "nth"], "full")
    one_side = (
        F.when(F.col("new_seq").isNull(), "deleted").when(F.col("old_seq").isNull(), "added")
        .otherwise("edited")
    )

    def named(pairs: DataFrame, change: str | Column) -> DataFrame:
        word = F.lit(change) if isinstance(change, str) else change
        return pairs.select("document_id", word.alias("change"), "old_seq", "new_seq")

    return named(kept, "kept").unionByName(named(moved, "moved")).unionByName(
        named(edited, one_side))


def change_summary(changes: DataFrame) -> DataFrame:
    """Blocks per document and kind of change, one column each."""
    kinds = ("kept", "moved", "edited", "added", "deleted")
    return changes.groupBy("document_id").agg(
        *[F.count_if(F.col("change") == k).alias(k) for k in kinds])

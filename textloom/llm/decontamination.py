"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts and items are lower-cased, every run of white space becomes one space. An item of n characters
occurs in a text if some part of the text turns into it with at most e = rate x n edits. By the
q-gram lemma such a part shares at least n - q + 1 - q x e q-grams with the item, and all of them lie
on e + 1 neighbouring diagonals (position in the text minus position in the item). Bands of 2 (e + 1)
diagonals, each overlapping half of the next, therefore hold a true occurrence whole. Bands with
enough shared q-grams are verified by edit distance along the band. Items of fewer than q characters
have no q-gram; they are found unchanged and as whole words, all at once by an automaton.

Every text is read once, where it lies; nothing is shuffled. Items are sent to the tasks in blocks
of bounded size: more items make more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, in_pieces, strings

_PIECE = 1 << 19
_TABLE_BITS = 22


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling the length hashed."""
    h, length = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while length < q:
        step = min(length, q - length)
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        length += step
    return h * np.uint64(0x94D049BB133111EB)


class Items:
    """One block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], q: int, rate: float):
        self.q = q
        named = list(zip(ids, map(normalise, texts), strict=True))
        kept = [(i, t) for i, t in named if len(t) >= q]
        short = [(i, t) for i, t in named if 0 < len(t) < q]
        # Short items are numbered after the others.
        self.ids = [i for i, _ in kept] + [i for i, _ in short]
        self.texts = [t for _, t in kept]
        self.short: dict[str, list[int]] = {}
        for number, (_, text) in enumerate(short, len(kept)):
            self.short.setdefault(text, []).append(number)
        self._automaton = None
        lengths = np.array([len(t) for t in self.texts], np.int64)
        # No more edits than leave at least one q-gram untouched.
        self.edits = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
        self.need = lengths - q + 1 - q * self.edits
        grams = [_gram_hashes(_points(t), q) for t in self.texts]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self._item, self._at = item[order], at[order].astype(np.int64)
        self._grams, first = np.unique(every[order], return_index=True)
        self._first = np.append(first, len(every))
        self._maybe = np.zeros(1 << _TABLE_BITS, bool)
        self._maybe[(self._grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.reach = int((lengths + 3 * self.edits).max(initial=0)) + q + 3

    def whole_words(self, piece: str, is_start: bool) -> Iterator[tuple[int, int]]:
        """(item, end) of the short items in a piece of a text, also of repeated ones.

        A letter or digit at an item's border must not go on with another one. What lies at a border
        of the piece is decided in the neighbouring piece, which overlaps this one.
        """
        if not self.short:
            return
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for text, numbers in self.short.items():
                self._automaton.add_word(text, (len(text), numbers))
            self._automaton.make_automaton()
        for last, (length, numbers) in self._automaton.iter(piece):
            at, end = last + 1 - length, last + 1
            if at == 0 and not is_start:
                continue
            if at and piece[at - 1].isalnum() and piece[at].isalnum():
                continue
            if end < len(piece) and piece[end].isalnum() and piece[last].isalnum():
                continue
            for number in numbers:
                yield number, end

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, position in the text, position in the item) of all shared q-grams."""
        text_at = np.flatnonzero(
            self._maybe[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)])
        found = np.searchsorted(self._grams, hashes[text_at])
        found = np.minimum(found, max(len(self._grams) - 1, 0))
        same = self._grams[found] == hashes[text_at] if len(self._grams) else np.zeros(0, bool)
        text_at, found = text_at[same], found[same]
        sizes = self._first[found + 1] - self._first[found]
        total = int(sizes.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(self._first[found], sizes) + inside
        return self._item[row], np.repeat(text_at, sizes), self._at[row]

    def bands(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands with enough shared q-grams."""
        item, text_at, item_at = self.shared(hashes)
        if not len(item):
            return
        width = self.edits[item] + 1
        band = (text_at - item_at) // width
        span = np.int64(len(hashes) + 2 * self.reach + 2)
        # Bands can be below zero at a text's start; the shift keeps the items apart.
        key = np.concatenate([item * span + band, item * span + band - 1]) + self.reach
        keys, counts = np.unique(key, return_counts=True)
        items = keys // span
        enough = counts >= self.need[items]
        numbers = keys - items * span - self.reach
        for i, b in zip(items[enough].tolist(), numbers[enough].tolist(), strict=True):
            w = int(self.edits[i]) + 1
            yield i, b * w, b * w + 2 * w - 1


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits that turn a part of ``text`` into ``item``, and where that part ends.

    Only alignments on the diagonals ``low`` to ``high`` count (position in the text minus position
    in the item).
    """
    # Beyond its ends the text goes on with a value that equals no character. Reading one costs as
    # much as leaving out the item's character, so the least cost is the same and no row of the
    # table needs a special case.
    before, after = max(-low, 0), max(high + len(item) - len(text), 0)
    row_text = np.concatenate([
        np.full(before, 0xFFFFFFFF, np.uint32), text, np.full(after, 0xFFFFFFFF, np.uint32)])
    width = high - low + 1
    slope = np.arange(width, dtype=np.int32)
    cost = np.zeros(width, np.int32)
    at = low + before
    for character in item:
        step = cost + (row_text[at:at + width] != character)
        np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])
        cost = np.minimum.accumulate(step - slope) + slope
        at += 1
    best = int(cost.argmin())
    return int(cost[best]), min(max(low + best + len(item), 0), len(text))


def find_items(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, end of the part in the normalised text), the best per text and item."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for pieces in _groups(texts, items.reach):
        joined = "\n".join(p for _, _, p, _ in pieces)  # a line end is in no normalised text
        starts = np.cumsum([0, *[len(p) + 1 for _, _, p, _ in pieces]])
        unsettled = []
        for row, shift, piece, whole in pieces:
            for item, end in items.whole_words(piece, shift == 0):
                # A piece that is not the last ends inside the next one, which sees what follows.
                if end < len(piece) or whole:
                    found = (0, shift + end)
                    best[row, item] = min(best.get((row, item), found), found)
        for item, low, high in items.bands(_gram_hashes(_points(joined), items.q)):
            needle, edits = items.texts[item], int(items.edits[item])
            first = max(int(np.searchsorted(starts, low, "right")) - 1, 0)
            stop = high + len(needle) + edits
            while first < len(pieces) and starts[first] < stop:
                row, shift, piece, _ = pieces[first]
                start = max(low - edits - int(starts[first]), 0)
                part = piece[start:max(stop - int(starts[first]), 0)]
                at = part.find(needle)
                if at >= 0:
                    end = shift + start + at + len(needle)
                    best[row, item] = min(best.get((row, item), (0, end)), (0, end))
                elif edits and len(part) >= len(needle) - edits:
                    offset = int(starts[first]) + start
                    unsettled.append((row, item, part, low - edits - offset,
                                      high + edits - offset, shift + start))
                first += 1
        for row, item, part, low, high, shift in unsettled:
            known = best.get((row, item))
            if known is not None and known[0] == 0:
                continue  # the neighbouring band holds it unchanged
            cost, end = banded_distance(_points(items.texts[item]), _points(part), low, high)
            found = (cost, shift + end)
            if cost <= items.edits[item] and (known is None or found < known):
                best[row, item] = found
    return sorted((row, item, *found) for (row, item), found in best.items())


def _groups(texts: list[str], overlap: int) -> Iterator[list[tuple[int, int, str, bool]]]:
    """(text, offset, piece, whether the text ends with it) lists of bounded size; pieces of one
    text overlap."""
    waiting, size = [], 0
    for row, text in enumerate(texts):
        text = normalise(text)
        start = 0
        while True:
            piece = text[start:start + _PIECE + overlap]
            if size and size + len(piece) > _PIECE:
                yield waiting
                waiting, size = [], 0
            waiting.append((row, start, piece, start + len(piece) >= len(text)))
            size += len(piece)
            start += _PIECE
            if start >= len(text):
                break
    if waiting:
        yield waiting


def _search(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in in_pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            hits = find_items(strings(batch.column("text")), block)
            yield pa.record_batch([
                pa.array([ids[row] for row, *_ in hits], pa.int64()),
                pa.array([block.ids[item] for _, item, *_ in hits], pa.int64()),
                pa.array([edits for _, _, edits, _ in hits], pa.int64()),
                pa.array([end for *_, end in hits], pa.int64()),
            ], names=["doc_id", "item_id", "edits", "end_at"])
    return run


def item_blocks(
    benchmark: DataFrame, q: int, rate: float, block_chars: int
) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_chars`` characters; repeated rows count once.

    A character takes about 40 bytes in every Python worker, so a block of 4 million takes 160 MB.
    """
    known = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        part = known.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        ).toPandas() if blocks > 1 else known.toPandas()
        yield Items(part["item_id"].tolist(), part["text"].tolist(), q, rate)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000,
) -> DataFrame:
    """doc_id, item_id, edits, end_at: one row per text and benchmark item that occurs in it.

    ``end_at`` is where the best occurrence ends in the normalised text. Clean, null and empty texts
    give no row, nor do null and empty items. Items with fewer than ``q`` normalised characters must
    occur unchanged between characters that do not carry on a word. Equal items are reported under
    each of their ids, repeated rows of the benchmark once, repeated rows of ``docs`` each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, end_at long"
    found = None
    for items in item_blocks(benchmark, q, rate, block_chars):
        part = texts.mapInArrow(_search(spark.sparkContext.broadcast(items)), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = 10, rate: float = 0.08,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, all columns as they were."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = docs.schema
    for items in item_blocks(benchmark, q, rate, block_chars):
        docs = docs.mapInArrow(
            _keep_clean(spark.sparkContext.broadcast(items), docs.columns.index(text_col)), schema)
    return docs


def _keep_clean(items, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            dirty = {row for row, *_ in find_items(strings(batch.column(text_at)), items.value)}
            yield batch.filter(pa.array(
                [i not in dirty for i in range(batch.num_rows)], pa.bool_()))
    return run

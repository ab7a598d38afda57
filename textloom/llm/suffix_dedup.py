"""Removal of every byte covered by a string of ``length`` bytes that also starts earlier.

Earlier means a smaller doc_id, or the same document and an earlier byte; strings never cross
documents and are judged on the input.

A suffix array of a whole corpus fits no machine, so suffixes are sorted where they can matter only.

1. Every window of ``length`` bytes chooses an anchor of ``anchor`` bytes inside it, by its content
   alone; neighbouring windows mostly choose the same one. Equal windows have equal anchors at equal
   places. A run of windows with one anchor is one narrow row: hash of the anchor, hash of the run's
   bytes, document and position.
2. Rows meet by anchor. Anchors that occur once are done. Of runs equal in all bytes, all but the
   first are repeats as a whole. What is left are anchors with several *different* runs.
3. Only those fetch their bytes. For each anchor the different runs are joined to one string, the
   part that all share as one symbol, and sorted by `suffix_sort`; the longest prefix that a suffix
   shares with an earlier one says which bytes are repeats. Anchors with very many different runs
   would make one large string, so beyond ``most_runs`` their windows are compared as rows instead,
   which gives the same answer and spreads over all tasks.

A run that many documents share is collapsed inside each piece of work before it is dealt out.
Texts travel once; those with runs of step 3 travel once more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import (
    blocks_by_size,
    byte_values,
    in_pieces,
    key_runs,
    runs_of,
    written,
)
from textloom.llm.suffix_sort import longest_earlier

_PIECE = 1 << 20
_MIX = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random value per byte."""
    n = 2 * _PIECE + 4096
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + (
        np.uint64(1))
    return np.cumprod(up), np.cumprod(down), values


class _Hashes:
    """Polynomial hashes of any substring of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        up, down, values = _powers()
        self._up = up
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * down[:len(data)], out=self._sums[1:])

    def every(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        h = (self._sums[size:] - self._sums[:n]) * self._up[:n]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        h = (self._sums[starts + sizes] - self._sums[starts]) * self._up[starts]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(30))


def window_anchors(data: np.ndarray, hashes: _Hashes, length: int, anchor: int) -> np.ndarray:
    """The anchor's position for each window of ``length`` bytes.

    The window's least hashed seed (a short string) lies at some offset; that offset modulo the
    number of places an anchor has in a window gives the anchor. As the window moves on, both
    numbers fall together, so the anchor stays.
    """
    places = length - anchor + 1
    seed = 4 + (anchor - 4) % places
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # The position in the low bits makes the leftmost of equal hashes the least.
    low = np.uint64((1 << 22) - 1)
    least = (hashes.every(seed) & ~low) | np.arange(len(data) - seed + 1, dtype=np.uint64)
    width, size = length - seed + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    at = np.minimum(least[:n], least[rest:rest + n]) & low
    starts = np.arange(n, dtype=np.int64)
    return starts + (at.astype(np.int64) - starts) % places


def _rows_of_block(
    ids: list[int], offsets: list[int], pieces: list[bytes], length: int, anchor: int
) -> pa.RecordBatch:
    """The runs of some pieces of texts; later copies of a run in the block are marked."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = _Hashes(data)
    chosen = window_anchors(data, hashes, length, anchor)
    owner = np.repeat(np.arange(len(pieces)), sizes)[:len(chosen)]
    inside = np.arange(len(chosen)) + length <= (begins + sizes)[owner]
    windows = np.flatnonzero(inside)
    # A run ends where the anchor, the piece or the row of windows does.
    first = np.ones(len(windows), bool)
    first[1:] = (chosen[windows[1:]] != chosen[windows[:-1]]) | (np.diff(windows) != 1) | (
        owner[windows[1:]] != owner[windows[:-1]])
    at = np.flatnonzero(first)
    low = windows[at]
    high = windows[np.append(at[1:], len(windows)) - 1] if len(at) else low
    place = chosen[low]
    key = hashes.of(place, anchor).view(np.int64)
    content = hashes.of(low, high - low + length) >> np.uint64(14) << np.uint64(14)
    packed = (content | ((high - low) << 7 | (place - low)).astype(np.uint64)).view(np.int64)
    doc = np.array(ids, np.int64)[owner[low]]
    start = low + (np.array(offsets, np.int64) - begins)[owner[low]]
    order = np.lexsort((start, doc, packed, key))
    key, packed = key[order], packed[order]
    same = np.zeros(len(order), bool)
    same[1:] = (key[1:] == key[:-1]) & (packed[1:] == packed[:-1])
    return pa.record_batch([
        pa.array(key), pa.array(packed), pa.array(doc[order]),
        # Later copies in this block are known as such: their start is told as -1 - start.
        pa.array(np.where(same, -1 - start[order], start[order])),
    ], names=["key", "content", "doc_id", "start"])


#: content: 50 bits of the hash of the run's bytes, then 7 bits each for the windows after the
#: first and the place of the anchor, both below ``length``.
_RUNS = "key long, content long, doc_id long, start long"


def _runs(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            pieces = []
            for i, text in zip(ids, byte_values(batch.column("text")), strict=True):
                # Pieces of a long text overlap by all but one byte of a window.
                for at in range(0, max(len(text) - length + 1, 0), _PIECE):
                    pieces.append((i, at, text[at:at + _PIECE + length - 1]))
            for a, b in blocks_by_size([len(p) for _, _, p in pieces], _PIECE):
                yield _rows_of_block(*map(list, zip(*pieces[a:b], strict=True)), length, anchor)
    return run


_FOUND = "doc_id long, start long, more short, lead short, key long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, content, document and start: whole repeats (key null), and the
    first of each of the different runs of an anchor."""
    for table in key_runs(batches, "key"):
        key, content, doc, start = (
            table.column(c).to_numpy() for c in ("key", "content", "doc_id", "start"))
        more, lead = (content >> 7 & 127).astype(np.int16), (content & 127).astype(np.int16)
        known = start < 0
        yield _found(doc[known], -1 - start[known], more[known], lead[known], None)
        key, content, doc, start, more, lead = (
            x[~known] for x in (key, content, doc, start, more, lead))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        starts, ends = runs_of(key)
        different = np.add.reduceat(fresh, starts) if len(starts) else np.empty(0, np.int64)
        several = fresh & np.repeat(different > 1, ends - starts)
        yield _found(doc[~fresh], start[~fresh], more[~fresh], lead[~fresh], None)
        yield _found(doc[several], start[several], more[several], lead[several], key[several])


def _found(doc, start, more, lead, key) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array(doc), pa.array(start), pa.array(more), pa.array(lead),
        pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key),
    ], names=["doc_id", "start", "more", "lead", "key"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that [start, end) spans cover; touching spans are one run."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _outcome(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str, bytes]:
    runs = merged(spans)
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest


_SPAN = "array<struct<start:long,end:long>>"
_TEXTS = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
    f"text binary, spans {_SPAN}, "
    "runs array<struct<key:long,start:long,lead:int,bytes:binary>>")
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUN_TYPE = pa.list_(pa.struct([
    ("key", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("bytes", pa.binary())]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, the form in which they travel and wait."""
    for batch in in_pieces(batches):
        small = [zlib.compress(t, 1) for t in byte_values(batch.column("text"))]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(small, pa.binary())], names=["doc_id", "text"])


def _fetch(length: int, with_kept: bool):
    """Results of texts without runs to compare; texts and bytes of the runs of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 256):
            rows = []
            for doc, small, found in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                batch.column("found").to_pylist(), strict=True,
            ):
                text, spans, runs = zlib.decompress(small), [], []
                for x in found or ():
                    end = x["start"] + x["more"] + length
                    if x["key"] is None:
                        spans.append((x["start"], end))
                    else:
                        runs.append({"key": x["key"], "start": x["start"], "lead": x["lead"],
                                     "bytes": text[x["start"]:end]})
                spans = merged(spans)
                if runs:
                    rows.append((doc, len(text), None, None, None, None, small,
                                 [{"start": a, "end": b} for a, b in spans], runs))
                else:
                    removed, n, digest, rest = _outcome(text, spans)
                    rows.append((doc, len(text), removed, n, digest, rest if with_kept else None,
                                 None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
                     pa.binary(), _SPAN_TYPE, _RUN_TYPE)
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text",
                       "spans", "runs"])
    return run


def repeats_among(
    runs: list[tuple[int, int, int, bytes]], length: int, anchor: int
) -> list[tuple[int, int, int]]:
    """(document, start, end) of the repeats among different runs with one anchor.

    ``runs`` are (document, start, bytes before the anchor, bytes) in order of document and start.
    """
    lefts = [data[:lead] for _, _, lead, data in runs]
    rights = [data[lead + anchor:] for _, _, lead, data in runs]
    before = _shared([left[::-1] for left in lefts])
    after = _shared(rights)
    m = len(runs)
    middle = m + 256
    symbols, owners, offsets = [], [], []
    for i, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        head, tail = left[:len(left) - before], right[after:]
        symbols += [m + b for b in head]
        symbols.append(middle)  # the anchor and all that every run has around it
        symbols += [m + b for b in tail]
        symbols.append((i + 1) % m)  # ends differ, and the last one is the least
        owners.append(len(symbols))
        offsets.append(len(head) + 1)
    size = before + anchor + after
    weights = [size if s == middle else 1 for s in symbols]
    known = longest_earlier(symbols, weights)
    out, start = [], 0
    for (doc, at, _, _), end, heads in zip(runs, owners, offsets, strict=True):
        for j in range(heads):  # suffixes that begin before or with the shared part
            if known[start + j] >= length:
                out.append((doc, at + j, at + j + known[start + j]))
        start = end
    return out


def _shared(texts: list[bytes]) -> int:
    """Length of the prefix that all texts share."""
    low, high = min(texts), max(texts)
    n = 0
    for a, b in zip(low, high, strict=False):
        if a != b:
            break
        n += 1
    return n


_MARKS = "doc_id long, start long, end long, window binary"


def _sort_runs(length: int, anchor: int, most_runs: int):
    """From runs sorted by key, document and start: repeats, or the windows of a crowded anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        last, crowded = None, False
        out: list[tuple] = []

        def finish() -> None:
            if len(held) > 1 and not crowded:
                out.extend((*x, None) for x in repeats_among(held, length, anchor))
            held.clear()

        def windows() -> None:
            for doc, at, _, data in held:
                for i in range(len(data) - length + 1):
                    out.append((doc, at + i, at + i + length, data[i:i + length]))
            held.clear()

        for batch in batches:
            for key, doc, start, lead, data in zip(
                *[batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "lead", "bytes")],
                strict=True,
            ):
                if key != last:
                    finish()
                    last, crowded = key, False
                held.append((doc, start, lead, data))
                if crowded or len(held) > most_runs:
                    crowded = True
                    windows()
                if len(out) >= 4096:
                    yield _marks(out)
                    out = []
        finish()
        yield _marks(out)
    return run


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                           names=["doc_id", "start", "end", "window"])


def _finish(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 256):
            rows = []
            for doc, small, spans, more in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                batch.column("spans").to_pylist(), batch.column("more").to_pylist(), strict=True,
            ):
                text = zlib.decompress(small)
                every = [(s["start"], s["end"]) for s in [*(spans or ()), *(more or ())]]
                removed, n, digest, rest = _outcome(text, every)
                rows.append((doc, len(text), removed, n, digest, rest if with_kept else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
    anchor: int = 56, most_runs: int = 2000, with_kept: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    Null texts count as empty. Ids must be whole and not repeat; a row without an id comes back
    unchanged, as it is neither before nor after another.
    """
    if not 4 < anchor <= length:
        raise ValueError("an anchor has at least five bytes and fits in a window")
    if length > 128:
        raise ValueError("a run's two numbers have seven bits each: windows up to 128 bytes")
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    runs = texts.where("doc_id is not null").mapInArrow(_runs(length, anchor), _RUNS)
    # Known copies need to meet nobody and are spread by document.
    to = F.when(F.col("start") < 0, F.xxhash64("doc_id", "start")).otherwise(F.col("key"))
    found = (
        runs.repartition(to).sortWithinPartitions("key", "content", "doc_id", "start")
        .mapInArrow(_compare, _FOUND)
    )
    per_doc = found.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "more", "lead", "key")).alias("found"))
    packed = texts.mapInArrow(_pack, "doc_id long, text binary")
    fetched = written(
        packed.join(per_doc, "doc_id", "left").select("doc_id", "text", "found")
        .mapInArrow(_fetch(length, with_kept), _TEXTS), "texts")
    marks = written(
        fetched.where("runs is not null").select("doc_id", F.explode("runs").alias("r"))
        .select("r.key", "doc_id", "r.start", "r.lead", "r.bytes")
        .repartition("key").sortWithinPartitions("key", "doc_id", "start")
        .mapInArrow(_sort_runs(length, anchor, most_runs), _MARKS), "marks")
    windows = marks.where("window is not null").select("doc_id", "start", "end", "window")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = windows.join(first, "window").where(
        F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "end")
    more = marks.where("window is null").select("doc_id", "start", "end").unionByName(later).groupBy(
        "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    open_ = (
        fetched.where("runs is not null").select("doc_id", "text", "spans")
        .join(more, "doc_id", "left").select("doc_id", "text", "spans", "more")
        .mapInArrow(_finish(with_kept), result))
    done = fetched.where("runs is null").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return done.unionByName(open_)

"""Repeated passages by content-defined chunks.

A gear hash over the last 16 bytes decides where chunks end, so an insertion moves the borders near
it only and later chunks are the same as before. Chunks meet by digest; every chunk but the first
(smallest doc_id, then smallest start) is a repeat. Neighbouring repeats of a document form a
passage, and passages of at least ``least_bytes`` are reported: short chunks also repeat by chance.

One narrow row per chunk is shuffled. A chunk that very many documents share is collapsed inside
each piece of work first: one row goes on to meet the others, and the later ones, already known as
repeats, are dealt out by document and place instead.

A passage is found by the chunks that lie whole inside it, so about a chunk is lost at each end.
`repeated_passages` therefore cuts finer than `chunk_repeats`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import blocks_by_size, byte_values, key_runs, runs_of

_PIECE = 1 << 21
#: A fixed random value per byte; only the low 16 bits of the rolling sum are used.
_GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of gear values, doubled once per byte of age.

    In 16 bits a value has left after 16 bytes, so four doublings of the length give all sums.
    """
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[shift:] = h[:-shift] if len(h) > shift else 0
        h = h + (older << np.uint16(shift))
    return h


def chunk_ends(data: bytes, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text: border where the top ``bits`` of the hash are zero, chunk sizes
    from ``least`` to ``most`` bytes (the last one may be shorter)."""
    ends, last = [], 0
    for start in range(0, len(data), _PIECE):
        head = max(start - 15, 0)
        part = np.frombuffer(data, np.uint8, min(len(data), start + _PIECE) - head, head)
        marks = np.flatnonzero(gear_hashes(part)[start - head:] >> np.uint16(16 - bits) == 0)
        for end in (marks + (start + 1)).tolist():
            while end - last > most:
                last += most
                ends.append(last)
            if end - last >= least:
                last = end
                ends.append(last)
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def _chunks(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, stop in blocks_by_size([len(t) for t in texts], _PIECE):
                yield from _collapsed(ids[first:stop], texts[first:stop], bits, least, most)
    return run


def _collapsed(ids, texts, bits, least, most) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, tuple[int, int]] = {}
    docs, starts, sizes, digests = [], [], [], []
    for doc, data in sorted(zip(ids.tolist(), texts, strict=True), key=lambda x: x[0]):
        start = 0
        for end in chunk_ends(data, bits, least, most):
            docs.append(doc)
            starts.append(start)
            sizes.append(end - start)
            digests.append(hashlib.blake2b(data[start:end], digest_size=16).digest())
            start = end
    earlier: list[int | None] = []
    for doc, start, digest in zip(docs, starts, digests, strict=True):
        earlier.append(seen[digest][0] if digest in seen else None)
        seen.setdefault(digest, (doc, start))
    known = pa.array(earlier, pa.int64())
    yield pa.record_batch([
        # Known repeats need to meet nobody. They go by document and place, in keys of at most
        # 2^16 bytes of text; a digest is longer, so it never equals such a key.
        pa.array([d if e is None else struct.pack(">qi", doc, start >> 16)
                  for d, e, doc, start in zip(digests, earlier, docs, starts, strict=True)],
                 pa.binary()),
        pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()),
        known,
    ], names=["digest", "doc_id", "start", "size", "earlier"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digest, document and start: the repeats, with the document before."""
    for table in key_runs(batches, "digest"):
        table = table.combine_chunks()
        digest = np.array(table.column("digest").to_pylist(), object)
        known = ~np.array(table.column("earlier").is_null())
        starts, ends = runs_of(digest)
        docs = table.column("doc_id").to_numpy()
        first = np.repeat(docs[starts], ends - starts)
        later = np.ones(len(docs), bool)
        later[starts] = False
        out = known | later
        earlier = np.where(known, table.column("earlier").fill_null(0).to_numpy(), first)
        yield pa.record_batch([
            pa.array(docs[out]), pa.array(table.column("start").to_numpy()[out]),
            pa.array(table.column("size").to_numpy()[out].astype(np.int64)),
            pa.array(earlier[out]),
        ], names=["doc_id", "start", "size", "earlier"])


def chunk_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits: int = 5, least: int = 16, most: int = 256,
) -> DataFrame:
    """doc_id, start, size, earlier: the chunks that occur before, with a document that has them.

    Positions are bytes of the UTF-8 text. Null and empty texts have no chunks. Rows without an id
    are left out; rows of one id count as one document with several texts.
    """
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).mapInArrow(
        _chunks(bits, least, most),
        "digest binary, doc_id long, start long, size int, earlier long")
    return (
        rows.repartition("digest").sortWithinPartitions("digest", "doc_id", "start")
        .mapInArrow(_repeats, "doc_id long, start long, size long, earlier long")
    )


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 100,
    bits: int = 4, least: int = 16, most: int = 256,
) -> DataFrame:
    """doc_id, start, n_bytes, n_chunks, earlier_doc_id: passages made of repeated chunks.

    ``earlier_doc_id`` is the smallest of the documents named for its chunks by `chunk_repeats`: each
    has the chunk and comes before (or is the same document), but need not be the first of all, as
    a hot chunk's repeats are told inside their piece of work. Texts without repeats give no row, nor do
    null and empty texts and rows without an id; ids should not repeat.
    """
    chunks = chunk_repeats(docs, id_col, text_col, bits, least, most)
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("size")).over(by_doc) != F.col("start"),
                        F.lit(True))
    return (
        chunks.withColumn("begins", begins.cast("int"))
        .withColumn("passage", F.sum("begins").over(by_doc))
        .groupBy("doc_id", "passage").agg(
            F.min("start").alias("start"), F.sum("size").alias("n_bytes"),
            F.count("*").alias("n_chunks"), F.min("earlier").alias("earlier_doc_id"))
        .where(F.col("n_bytes") >= least_bytes).drop("passage")
    )

"""Token ids of documents in binary files of patched frame-of-reference blocks.

A folder holds shards and one manifest. The shards follow each other in ascending document order;
a shard is one stream of token ids, cut into blocks regardless of document ends:

    magic
    block ...      minimum, width, number of values, number of exceptions (``_HEAD``),
                   values minus the minimum, ``width`` bits each, lowest bit first,
                   positions of the exceptions (16 bits each), their values minus the minimum
    footer         starts of the blocks, document lengths, known-id flags, document ids
    trailer        documents, ids, blocks, block size, start of the footer, magic (``_TAIL``)

The width of a block is that of a percentile of its values, so a few large ids do not widen all
others; values beyond it are exceptions and stand in the block's list. Block starts make any range
of ids readable without the ids before it (`read_range`).

Spark writes and reads the folder as the data source ``token_blocks``: a task writes one shard under
a name of its own, and only the shards of committed tasks enter the manifest, so a lost or repeated
task leaves no trace in what is read. Files are opened through ``pyarrow.fs``, so the folder may lie
on any file system that it knows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

MAGIC = b"TOKPFOR1"
MANIFEST = "_manifest.json"
BLOCK = 4096
PERCENTILE = 95.0
_HEAD, _TAIL = "<IBxHH", "<QQQQQ8s"
#: A reader's batch ends after that many ids or documents.
_BATCH_IDS, _BATCH_DOCS = 1 << 20, 10_000


# ---- blocks

def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """At most 65,535 unsigned 32-bit values as one block; an empty array is an empty block."""
    values = values.astype(np.uint32, copy=False)
    least = values.min() if len(values) else np.uint32(0)
    above = values - least
    typical = int(np.percentile(above, percentile, method="lower")) if len(values) else 0
    width = typical.bit_length()
    patched = np.flatnonzero(above >> np.uint64(width)) if width < 32 else np.empty(0, np.int64)
    low = above.copy()
    low[patched] = 0
    bits = (low[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return b"".join((
        struct.pack(_HEAD, int(least), width, len(values), len(patched)),
        np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        patched.astype("<u2").tobytes(), above[patched].astype("<u4").tobytes(),
    ))


def unpack_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    """The values of the block that starts at byte ``at``."""
    least, width, count, patches = struct.unpack_from(_HEAD, data, at)
    at += struct.calcsize(_HEAD)
    size = (count * width + 7) // 8
    bits = np.unpackbits(
        np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little")
    weights = np.uint32(1) << np.arange(width, dtype=np.uint32)
    out = bits.reshape(count, width).astype(np.uint32) @ weights if width else np.zeros(
        count, np.uint32)
    where = np.frombuffer(data, "<u2", patches, at + size)
    out[where] = np.frombuffer(data, "<u4", patches, at + size + 2 * patches)
    return out + np.uint32(least)


# ---- shards

@dataclass
class ShardWriter:
    """Writes one shard to an open binary stream; holds one block and 17 bytes per document."""

    out: object
    block: int = BLOCK
    percentile: float = PERCENTILE
    starts: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    doc_ids: list[int | None] = field(default_factory=list)
    waiting: list[np.ndarray] = field(default_factory=list)
    n_waiting: int = 0
    n_ids: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.block < 1 << 16:
            raise ValueError("a block holds 1 to 65,535 values")
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            self._flush(self.n_waiting // self.block * self.block)

    def _flush(self, count: int) -> None:
        values = np.concatenate(self.waiting)
        for start in range(0, count, self.block):
            data = pack_block(values[start:min(start + self.block, count)], self.percentile)
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [values[count:].copy()], len(values) - count

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        for part in (np.array(self.starts, "<u8"), np.array(self.lengths, "<u8"), known,
                     np.array([d or 0 for d in self.doc_ids], "<i8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(
            _TAIL, len(self.doc_ids), self.n_ids, len(self.starts), self.block, self.at, MAGIC))


class ShardReader:
    """Random access to one shard; ``source`` is a seekable binary stream of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        tail_size = struct.calcsize(_TAIL)
        tail = self._bytes(size - tail_size, tail_size)
        n_docs, self.n_ids, n_blocks, self.block, footer, magic = struct.unpack(_TAIL, tail)
        if magic != MAGIC:
            raise ValueError("not a shard of token blocks")
        rest = self._bytes(footer, size - tail_size - footer)
        at = 8 * n_blocks
        self.starts = np.append(np.frombuffer(rest, "<u8", n_blocks), np.uint64(footer))
        self.lengths = np.frombuffer(rest, "<u8", n_docs, at).astype(np.int64)
        known = np.frombuffer(rest, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.doc_ids = pa.array(
            np.frombuffer(rest, "<i8", n_docs, at + 9 * n_docs), mask=~known)

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the shard; only their blocks are read."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        low = int(self.starts[first])
        data = self._bytes(low, int(self.starts[last + 1]) - low)
        parts = [unpack_block(data, int(self.starts[b]) - low) for b in range(first, last + 1)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[start - first * self.block:stop - first * self.block]

    def batches(self, start: int) -> Iterator[pa.RecordBatch]:
        """Documents in order, with ``start`` as the number of ids before the shard."""
        ends = np.cumsum(self.lengths)
        doc, at = 0, 0
        while doc < len(ends):
            stop = min(doc + _BATCH_DOCS, len(ends),
                       max(doc + 1, int(np.searchsorted(ends, at + _BATCH_IDS, "right"))))
            own = self.ids(at, int(ends[stop - 1]))
            begins = ends[doc:stop] - self.lengths[doc:stop]
            offsets = np.append(begins - at, len(own)).astype(np.int64) * 4
            yield pa.record_batch([
                self.doc_ids[doc:stop], pa.array(begins + start), pa.array(self.lengths[doc:stop]),
                pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), stop - doc,
                    [None, pa.py_buffer(offsets.tobytes()),
                     pa.py_buffer(own.astype("<u4").tobytes())]).cast(pa.binary()),
            ], names=["doc_id", "start", "n_tokens", "ids"])
            doc, at = stop, int(ends[stop - 1])


# ---- folders

def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):  # Spark also writes file:/a and file:///a
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder.rstrip("/"))


def _manifest(folder: str) -> list[dict]:
    system, path = _file_system(folder)
    with system.open_input_stream(f"{path}/{MANIFEST}") as source:
        return json.loads(source.read())


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str | None
    n_docs: int = 0
    n_ids: int = 0


@dataclass
class _Shard(InputPartition):
    file: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, options: dict):
        self.folder = folder
        self.block = int(options.get("block", BLOCK))
        self.percentile = float(options.get("percentile", PERCENTILE))
        self.tokenizer = options.get("tokenizer")
        self.end = struct.pack("<I", int(options["endid"])) if "endid" in options else b""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = _file_system(self.folder)
        partition, name, shard, out = TaskContext.get().partitionId(), None, None, None
        encode = WordEncoder(self.tokenizer).encode if self.tokenizer else bytes
        for batch in iterator:
            values = batch.column("text" if self.tokenizer else "ids")
            for doc_id, value in zip(batch.column("doc_id"), values, strict=True):
                if shard is None:
                    name = f"shard-{partition:06d}-{uuid.uuid4().hex}.tok"
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}")
                    shard = ShardWriter(out, self.block, self.percentile)
                value = value.as_py()
                data = b"" if value is None else encode(value)
                shard.add(doc_id.as_py(), np.frombuffer(data + self.end, "<u4"))
        if shard is None:
            return _Written(partition, None)
        shard.close()
        out.close()
        return _Written(partition, name, len(shard.doc_ids), shard.n_ids)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, path = _file_system(self.folder)
        shards, start = [], 0
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.partition):
            shards.append({"file": m.file, "n_docs": m.n_docs, "start": start, "n_ids": m.n_ids})
            start += m.n_ids
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}.new") as out:
            out.write(json.dumps(shards).encode())
        system.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        """Shards of a failed job stay unlisted; a folder without a manifest reads as an error."""


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        # One empty partition stands for an empty folder.
        return [_Shard(s["file"], s["start"]) for s in _manifest(self.folder)] or [_Shard("", 0)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, path = _file_system(self.folder)
        with system.open_input_file(f"{path}/{partition.file}") as source:
            yield from ShardReader(source, source.size()).batches(partition.start)


class TokenBlocks(DataSource):
    """The data source ``token_blocks``: (doc_id, start, n_tokens, ids as 32-bit little endian).

    Written are (doc_id, ids), or (doc_id, text) with the option ``tokenizer``, the path of a
    tokenizer file; the option ``endid`` is appended to every document.
    """

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], dict(self.options))


def read_range(folder: str, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a written folder, without Spark, as a training loader wants them."""
    system, path = _file_system(folder)
    parts = []
    for shard in _manifest(folder):
        low, high = start - shard["start"], stop - shard["start"]
        if low < shard["n_ids"] and high > 0:
            with system.open_input_file(f"{path}/{shard['file']}") as source:
                parts.append(ShardReader(source, source.size()).ids(low, high))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


# ---- encoding

#: Characters below U+0250 are starters, so normal form C leaves them alone, and all but U+0130 have
#: a lower case of one character. U+001C to U+001F part words for Python alone.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\u012f\u0131-\u024f]*")


def _byte_letters() -> list[str]:
    """Byte-level BPE writes visible bytes as themselves, the others as letters from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


class _Chunks(dict):
    """The ids of what stands between white space, as bytes; kept while there is room."""

    def __init__(self, library, pattern, most: int):
        super().__init__()
        self.model, self.pattern, self.most = library.model, pattern, most
        self.letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # letters, then a mark: two words
            return self[chunk[:-1]] + self[chunk[-1]]
        ids = []
        for word in [chunk] if chunk.isalpha() else self.pattern.findall(chunk):
            spelt = word if word.isascii() and word.isalpha() else "".join(
                map(self.letters.__getitem__, word.encode()))
            ids += [t.id for t in self.model.tokenize(spelt)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most and len(chunk) <= 64:
            self[chunk] = out
        return out


class WordEncoder:
    """A tokenizer whose words do not depend on each other, with the ids of chunks of text kept.

    A word never spans white space. Texts of plain characters (`_PLAIN`) are lower-cased and cut at
    white space here; a new chunk is cut by the tokenizer's own word pattern and its words are
    encoded by the library's model. Any other text, and one that could hold a special string, is
    encoded by the library as a whole. ``most`` bounds what is kept; results do not depend on it.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = self._word_pattern(spec)
        self.chunks = _Chunks(self.library, self.pattern, most)

    @staticmethod
    def _word_pattern(spec: dict):
        """The word pattern, if the tokenizer normalises and cuts as this class does."""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != [
            "Split", "ByteLevel"
        ] or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed":
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"], regex.V0)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if (self.pattern is None or not _PLAIN.fullmatch(text)
                or any(s in text for s in self.special)):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20,
    block: int = BLOCK, percentile: float = PERCENTILE,
) -> None:
    """Token ids of every whole text, each closed by ``end_id``, as shards in ascending id order.

    Null texts count as empty, so they are the end id alone. Null ids come first; rows with the
    same id follow each other in the order of their texts. An empty table gives a folder without
    shards. Texts are dealt to shards by ranges of ids, about ``shard_bytes`` of text each.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    spark = docs.sparkSession
    spark.dataSource.register(TokenBlocks)
    system, path = _file_system(folder)
    if system.get_file_info(f"{path}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} already holds token files")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    (
        rows.repartitionByRange(int(shards), order[0]).sortWithinPartitions(*order)
        .write.format("token_blocks").option("tokenizer", tokenizer).option("endid", end_id)
        .option("block", block).option("percentile", percentile).mode("append").save(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder; ``start`` counts the ids before.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").load(folder)


def token_table(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """Writes ``docs`` to ``folder`` and returns one row per document as read back from its files.

    doc_id, start, n_tokens (with the end id), ids_crc32 (unsigned, over the ids' bytes).
    """
    write_tokens(docs, folder, tokenizer, end_id, id_col, text_col, **options)
    return read_tokens(docs.sparkSession, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

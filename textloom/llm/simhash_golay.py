"""SimHash near-duplicates found through Golay-code keys.

A fingerprint has 64 bits, cut into segments of 23, 23 and 18 bits (the last one padded to 23).
The perfect Golay code [23,12,7] maps every 23-bit value to the index of the one codeword within
three bits. A segment's *near keys* are the indices of the value itself and of its 23 neighbours:
one key, or six. Two segments that differ in at most two bits share a near key, because a value
between them is a neighbour of both; if they differ in one bit, the plain index of either is a near
key of the other.

Two fingerprints that differ in at most four bits leave two of the three segments with at most two
differing bits together, so one of these holds for some pair of segments:

* one segment is equal and the other differs in at most two bits: they share
  (whole segment, near key);
* both differ in one bit: they share (near key of the first, index of the second), where the one
  side contributes near keys for the first segment and the other side for the second.

That gives about 64 narrow rows per *distinct* fingerprint. Rows meet by key, every candidate is
verified on all 64 bits, and each bucket passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, byte_values, in_pieces, key_runs, runs_of, written
from textloom.llm.components import smallest_reachable
from textloom.operators.large_memory import key_filter, may_match

#: The generator polynomial of the Golay code (degree 11) and the segment widths.
GENERATOR = 0b101011100011
WIDTHS = (23, 23, 18)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEED = 42


@lru_cache(1)
def _error_of_syndrome() -> np.ndarray:
    """For each of the 2048 remainders, the error of at most three bits that leaves it."""
    singles = [_remainders(np.array([1 << i], np.int64))[0] for i in range(23)]
    table = np.zeros(2048, np.int64)
    for i in range(23):
        table[singles[i]] = 1 << i
        for j in range(i):
            table[singles[i] ^ singles[j]] = 1 << i | 1 << j
            for k in range(j):
                table[singles[i] ^ singles[j] ^ singles[k]] = 1 << i | 1 << j | 1 << k
    return table


def _remainders(values: np.ndarray) -> np.ndarray:
    rest = values.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


@lru_cache(1)
def _nearest_index() -> np.ndarray:
    """Codeword index (its 12 high bits) for every 23-bit value."""
    values = np.arange(1 << 23, dtype=np.int64)
    return ((values ^ _error_of_syndrome()[_remainders(values)]) >> 11).astype(np.int16)


def codeword_index(values: np.ndarray) -> np.ndarray:
    return _nearest_index()[values].astype(np.int64)


def near_keys(values: np.ndarray) -> np.ndarray:
    """(n, 6) indices for n values; a value with one key has it six times."""
    around = np.sort(_nearest_index()[
        values[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    ].astype(np.int64), axis=1)
    fresh = np.ones(around.shape, bool)
    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :6]
    keys = np.take_along_axis(around, order, 1)
    return np.where(np.take_along_axis(fresh, order, 1), keys, keys[:, :1])


def segments(prints: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for width in WIDTHS:
        out.append(((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    return out


def _key_columns(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of every bucket that a fingerprint goes to, without repeats."""
    parts = segments(prints)
    index = [codeword_index(p) for p in parts]
    near = [near_keys(p) for p in parts]
    keys = []
    for kind, (i, j) in enumerate([(0, 1), (0, 2), (1, 2), (1, 0), (2, 0), (2, 1)]):
        # One segment whole, the other by near keys.
        keys.append((8 + kind << 40) | (parts[i][:, None] << 12) | near[j])
        if i < j:
            keys.append((kind << 40) | (near[i] << 12) | index[j][:, None])
            keys.append((kind << 40) | (index[i][:, None] << 12) | near[j])
    table = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    return table[fresh], np.repeat(prints, fresh.sum(1))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set when it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounded, also for very long texts
        part = hashes[start:start + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """XXH64 of all word shingles of a text; a shorter text is one shingle."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(min(words, len(parts))))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, _SEED) for s in shingles], np.uint64)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            prints = np.array([
                fingerprint_of(shingle_hashes(text, words)) for text in byte_values(batch.column(1))
            ], np.uint64)
            yield pa.record_batch(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4
) -> DataFrame:
    """(doc_id, print): 64 bits as a signed long; zero for null, empty or blank texts.

    Words are what lies between characters of `[\\x20\\x09-\\x0D]`, A-Z lower-cased.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    ).mapInArrow(_fingerprints(words), "doc_id long, print long")


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches, 4096):
        prints = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64)
        keys, owners = _key_columns(prints)
        yield pa.record_batch(
            [pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "print"])


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: at most one fewer than there are fingerprints.

    Searches breadth first: what a fingerprint reaches leaves the pool, so a cloud of near copies
    empties the pool after a few comparisons.
    """
    pool = prints.view(np.uint64)
    left, right = [], []
    waiting: list[np.uint64] = []
    while len(pool):
        if waiting:
            at = waiting.pop()
        else:
            at, pool = pool[0], pool[1:]
            if not len(pool):
                break
        close = np.bitwise_count(pool ^ at) <= distance
        reached = pool[close]
        if len(reached):
            left.append(np.full(len(reached), at))
            right.append(reached)
            waiting.extend(reached)
            pool = pool[~close]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def _bucket_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "key"):
            keys = table.column("key").to_numpy()
            prints = table.column("print").to_numpy()
            starts, ends = runs_of(keys)
            sizes = ends - starts
            twos = starts[sizes == 2]
            a, b = prints[twos], prints[twos + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            found = [(a[near], b[near])]
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                found.append(forest(prints[s:e], distance))
            yield pa.record_batch([
                pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)
            ], names=["a", "b"])
    return run


def print_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``distance`` bits.

    ``prints`` has one column ``print`` without repeats. Keys are complete up to four bits.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the keys find fingerprints that differ in at most four bits")
    keys = prints.select("print").mapInArrow(_bucket_keys, "key long, print long")
    return (
        keys.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_bucket_links(distance), "a long, b long")
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 4, distance: int = 4,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).

    Equal fingerprints are one class and never paired; rows with a null id get a component too
    (null only where no member has an id). An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "prints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    parts = smallest_reachable(print_links(classes.select("print"), distance))
    by_print = classes.join(
        parts.withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("part", F.coalesce("component", "print"))
    smallest = by_print.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = by_print.join(smallest, "part").select("print", "component_id")
    return rows.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 4, distance: int = 4,
) -> DataFrame:
    """The row with the smallest id of each component, all columns as they were.

    Rows without an id stay: nothing tells which of them is first. Repeated ids stay or go together.
    """
    groups = near_groups(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, words,
                         distance)
    drop = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_drop")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(f"`{id_col}`").cast("long").alias("_id"))
    return rows.join(drop, F.col("_id") == F.col("_drop"), "left_anti").select("_doc.*")


# ---- near copies by similarity of word shingles

#: Fixed values of the search by similarity: keys per text and smallest hashes per key, bits of a
#: sketch, and how many of them texts of similarity 0.8 share but for one pair in 100,000.
BANDS, BAND_ROWS, SKETCH_BITS, LEAST_EQUAL = 30, 5, 128, 101
#: Rows up to which a bucket is compared in place, documents and bytes of a part of a cloud.
SMALL_BUCKET, PART_ROWS, PART_BYTES = 256, 2048, 32 << 20

_FACTORS = np.random.default_rng(20_240_301).integers(
    0, 1 << 63, (4, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_values(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set of shingle hashes under each of 150 mixings."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 256):  # bounded, also for very long texts
        part = hashes[start:start + 256, None]
        mixed = (part ^ part >> np.uint64(31)) * _FACTORS[0] + _FACTORS[1]
        least = np.minimum(least, mixed.min(0))
    return (least ^ least >> np.uint64(29)) * _FACTORS[2]


def band_keys(least: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes: each of ``BAND_ROWS`` smallest values.

    Sets of Jaccard similarity J share a given key with probability J ** BAND_ROWS, so at 0.8 all
    30 keys of a pair differ for one pair in 150,000, above that for fewer.
    """
    keys = least.reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(32)) * _FACTORS[3, :BANDS]


def sketch_bits(least: np.ndarray) -> np.ndarray:
    """One bit of each of 128 smallest values, as two words: equal with probability (1 + J) / 2."""
    return np.packbits((least[:SKETCH_BITS] >> np.uint64(63)).astype(bool)).view("<u8")


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            at, prints, sizes, bits, keys, lengths = [], [], [], [], [], []
            for i, text in enumerate(byte_values(batch.column(1))):
                hashes = shingle_hashes(text, words)
                if len(hashes):
                    different = np.unique(hashes)
                    least = _least_values(different)
                    at.append(i)
                    prints.append(fingerprint_of(hashes))
                    sizes.append(len(different))
                    bits.append(sketch_bits(least))
                    keys.append(band_keys(least))
                    lengths.append(len(text))
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            two = np.array(bits, np.uint64).reshape(-1, 2)
            yield pa.record_batch([
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                pa.array(two[:, 0].view(np.int64)), pa.array(two[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS),
                    pa.array(flat.view(np.int64))),
                pa.array(lengths, pa.int64()),
            ], names=["doc_id", "print", "size", "b0", "b1", "keys", "bytes"])
    return run


_SKETCH = ("doc_id long, print long, size long, b0 long, b1 long, keys array<long>, bytes long")


class _Sketches:
    """Sketches of some documents; ``likely`` tells which of them may be similar to one."""

    def __init__(self, table: pa.Table, similarity: float):
        self.ids, size, b0, b1 = (
            table.column(c).to_numpy() for c in ("doc_id", "size", "b0", "b1"))
        self.size, self.b0, self.b1 = size, b0.view(np.uint64), b1.view(np.uint64)
        self.similarity = similarity

    def likely(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sizes of similar sets differ by a bounded factor, and so do their sketches."""
        differ = (np.bitwise_count(self.b0[others] ^ self.b0[one]).astype(np.int64)
                  + np.bitwise_count(self.b1[others] ^ self.b1[one]))
        small = np.minimum(self.size[others], self.size[one])
        return others[(differ <= SKETCH_BITS - LEAST_EQUAL) & (
            small >= self.similarity * np.maximum(self.size[others], self.size[one]))]


def _spanning(rows: np.ndarray, reach) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``rows``; ``reach(i, pool)`` gives what i links to.

    Breadth first: what is reached leaves the pool, so a cloud of near copies soon empties it.
    """
    links, waiting, pool = [], [], rows
    while len(pool):
        if waiting:
            at = waiting.pop()
        else:
            at, pool = pool[0], pool[1:]
        reached = reach(at, pool)
        if len(reached):
            links += [(at, other) for other in reached]
            waiting.extend(reached)
            pool = pool[~np.isin(pool, reached)]
    return links


def _bucket_clouds(similarity: float):
    """From rows sorted by key: links that hold together what may be similar in a bucket.

    A small bucket is compared in place. Of a larger one every row is linked to the first, as it
    streams past, so no bucket is ever held as a whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, first = None, None, None  # the open bucket: its rows, or its first document

        def close(table: pa.Table) -> list[tuple[int, int]]:
            sketches, found = _Sketches(table, similarity), []
            starts, ends = runs_of(table.column("key").to_numpy())
            for s, e in zip(starts, ends, strict=True):
                if e - s > SMALL_BUCKET:
                    found += [(sketches.ids[s], other) for other in sketches.ids[s + 1:e]]
                elif e - s > 1:
                    found += [(sketches.ids[i], sketches.ids[j]) for i, j in _spanning(
                        np.arange(s, e), sketches.likely)]
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            found, keys = [], batch.column("key").to_numpy()
            start = 0
            if first is not None:  # the rest of a large bucket
                more = int(np.searchsorted(keys != key, True)) if (keys != key).any() else len(keys)
                found += [(first, other) for other in batch.column("doc_id").to_numpy()[:more]]
                start = more
                first = first if more == len(keys) else None
            if start < len(keys):
                rest = pa.Table.from_batches([batch.slice(start)])
                table = rest if held is None else pa.concat_tables([held, rest])
                starts, _ = runs_of(table.column("key").to_numpy())
                open_at = int(starts[-1])
                found += close(table.slice(0, open_at))
                held = table.slice(open_at)
                key = held.column("key")[0].as_py()
                if held.num_rows > SMALL_BUCKET:
                    found += close(held)
                    first, held = held.column("doc_id")[0].as_py(), None
            yield _links(found)
        if held is not None:
            yield _links(close(held))
    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.record_batch(
        [pa.array(pairs.min(1)), pa.array(pairs.max(1))] if len(pairs) else
        [pa.array([], pa.int64())] * 2, names=["a", "b"])


def shingle_set(text: bytes, words: int) -> frozenset[tuple[bytes, ...]]:
    parts = text.translate(_LOWER).split()
    return frozenset(zip(*(parts[i:] for i in range(min(words, len(parts))))))


def _similar(words: int, similarity: float):
    """From rows sorted by cloud and part: links that connect all similar documents of a part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "part"):
            for s, e in zip(*runs_of(table.column("part").to_numpy()), strict=True):
                rows = table.slice(s, e - s)
                sketches = _Sketches(rows, similarity)
                sets = [shingle_set(t, words) for t in byte_values(rows.column("text"))]

                def reach(at, pool, sets=sets, sketches=sketches):
                    own, out = sets[at], []
                    for other in sketches.likely(at, pool):
                        both = len(own & sets[other])
                        if both and both >= similarity * (len(own) + len(sets[other]) - both):
                            out.append(other)
                    return np.array(out, np.int64)

                yield _links([(sketches.ids[i], sketches.ids[j])
                              for i, j in _spanning(np.arange(e - s), reach)])
    return run


def candidate_links(sketches: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) after which all documents that may be similar are connected.

    Golay keys connect documents whose fingerprints differ in at most four bits, which holds the
    clouds of near copies together; keys of smallest hashes (`band_keys`) find the rest.
    """
    classes = written(sketches.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    equal = sketches.join(classes, "print").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b"))
    near = print_links(classes.select("print"))
    name = classes.select(F.col("print"), "first")
    near = (
        near.join(name.select(F.col("print").alias("a"), F.col("first").alias("x")), "a")
        .join(name.select(F.col("print").alias("b"), F.col("first").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    bands = (
        sketches.select(F.explode("keys").alias("key"), "doc_id", "size", "b0", "b1")
        .repartition("key").sortWithinPartitions("key", "doc_id")
        .mapInArrow(_bucket_clouds(similarity), "a long, b long")
    )
    return equal.unionByName(near).unionByName(bands).where("a != b").distinct()


def similar_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """Links (a, b) that connect all documents whose sets of word shingles are that similar.

    Candidates (`candidate_links`) only say which documents form a cloud; every link is checked on
    the texts. A cloud's texts meet in one task as far as they are few; a larger cloud is cut into
    parts by a hash of the id, and each two parts meet in a task of their own. Tasks give back
    spanning forests, never pairs of a group.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    sketches = written(texts.mapInArrow(_sketches(words), _SKETCH), "sketches")
    clouds = smallest_reachable(candidate_links(sketches, similarity))
    rows = written(
        sketches.join(clouds, F.col("doc_id") == F.col("node"))
        .select("component", "doc_id", "size", "b0", "b1", "bytes"), "clouds")
    parts = rows.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("bytes") / PART_BYTES), F.lit(1),
    ).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    # The number of a pair of parts, lower part first; a cloud of one part has one.
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.xxhash64("component", F.least(own, p), F.greatest(own, p)))
    tasks = rows.join(parts, "component").select(
        F.explode(F.array_distinct(pair)).alias("part"), "doc_id", "size", "b0", "b1")
    # Texts outside all clouds stay where they lie.
    members = key_filter(rows, columns=["doc_id"])
    if members is not None:
        texts = texts.where(may_match(docs.sparkSession, members, ["doc_id"]))
    return (
        tasks.join(texts, "doc_id").repartition("part").sortWithinPartitions("part", "doc_id")
        .mapInArrow(_similar(words, similarity), "a long, b long")
    )


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """The row with the smallest id of each group connected by ``similar_links``.

    All columns stay as they were, and so do rows without an id and texts without words. Repeated
    ids stay or go together.
    """
    parts = smallest_reachable(similar_links(docs, id_col, text_col, words, similarity))
    drop = written(parts.where("node != component").select(F.col("node").alias("_drop")), "drop")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(f"`{id_col}`").cast("long").alias("_id"))
    copies = key_filter(drop, columns=["_drop"])
    alone = None
    if copies is not None:  # only rows that may be copies are moved
        rows = rows.withColumn("_maybe", may_match(docs.sparkSession, copies, ["_id"]))
        alone, rows = rows.where("NOT _maybe").select("_doc.*"), rows.where("_maybe")
    rows = rows.join(drop, F.col("_id") == F.col("_drop"), "left_anti").select("_doc.*")
    return rows if alone is None else alone.unionByName(rows)

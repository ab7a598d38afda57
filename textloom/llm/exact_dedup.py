"""Exact duplicates through a cuckoo-filter index of live digests.

Texts are equal when they are identical after deleting the characters of `[\\x20\\x09-\\x0D]`; null
counts as the empty text. Of equal texts the row with the most code points in its original text
stays, then the smallest id (null ids last), then any one row of those left.

Shape of the job: a digest per row is computed in the JVM and written once (about 60 bytes a row).
Every task collapses its own rows through an index, so that a group holding a third of all rows
leaves each task as one row. The rest meets by digest, is sorted by shard (the digest's first two
bytes), and each shard passes through one index that holds that shard's digests only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_SPACE, written
from textloom.operators.large_memory import key_filter, may_match

_SLOTS = 4
_MAX_KICKS = 200
_GROUP_SCHEMA = (
    "shard int, digest binary, keep_points long, keep_id long, keep_row long, copies long"
)


class CuckooIndex:
    """A cuckoo filter whose slots also hold the whole digest and a value.

    A fingerprint hit is a candidate only: it counts when the digest stored in that slot is the
    one asked for. Digests can be deleted. When an insertion finds no place, or the table is
    nearly full, the table doubles and is filled again from the stored digests.
    """

    def __init__(self, buckets: int = 64):
        self.resizes = 0
        self._allocate(buckets)

    def _allocate(self, buckets: int) -> None:
        size = 1
        while size < buckets:
            size *= 2
        self._mask = size - 1
        self._marks: list[list[int]] = [[] for _ in range(size)]
        self._stored: list[list[list]] = [[] for _ in range(size)]
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little")
        first = int.from_bytes(digest[:8], "little") & self._mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        # The step depends on the fingerprint alone, so either bucket gives the other.
        return bucket ^ (((mark + 1) * 0x5BD1E995 >> 7) & self._mask)

    def find(self, digest: bytes) -> list | None:
        """The stored [digest, value] entry, or None."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if mark in self._marks[bucket]:
                for entry in self._stored[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, value) -> None:
        """Adds a digest that is not live yet."""
        if self.live >= (self._mask + 1) * _SLOTS * 0.9:
            self._grow()
        entry = [digest, value]
        while not self._put(entry):
            self._grow()

    def _put(self, entry: list) -> bool:
        mark, bucket, second = self._places(entry[0])
        if len(self._marks[bucket]) >= _SLOTS:
            bucket = second
        moved = []
        for kick in range(_MAX_KICKS):
            if len(self._marks[bucket]) < _SLOTS:
                self._marks[bucket].append(mark)
                self._stored[bucket].append(entry)
                self.live += 1
                return True
            slot = kick % _SLOTS
            moved.append((bucket, slot, mark, entry))
            self._marks[bucket][slot], mark = mark, self._marks[bucket][slot]
            self._stored[bucket][slot], entry = entry, self._stored[bucket][slot]
            bucket = self._other(bucket, mark)
        for bucket, slot, _, _ in reversed(moved):  # undo, so that no digest is lost
            self._marks[bucket][slot], mark = mark, self._marks[bucket][slot]
            self._stored[bucket][slot], entry = entry, self._stored[bucket][slot]
        return False

    def _grow(self) -> None:
        entries = list(self.entries())
        size = self._mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._allocate(size)
            if all(self._put(entry) for entry in entries):
                return

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot, entry in enumerate(self._stored[bucket]):
                if entry[0] == digest:
                    del self._marks[bucket][slot], self._stored[bucket][slot]
                    self.live -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self._stored:
            yield from bucket


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as binary."""
    return F.unhex(F.sha2(normalised(text), 256))


def row_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, points, digest, row) of every row; ``row`` tells equal rows apart."""
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
        text_digest(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a = (points, id, row) stays rather than row b."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return b[1] is None or (a[1] is not None and a[1] < b[1])
    return a[2] < b[2]


def _merge(index: CuckooIndex, digest: bytes, best: tuple, copies: int) -> None:
    entry = index.find(digest)
    if entry is None:
        index.insert(digest, [best, copies])
        return
    value = entry[1]
    value[1] += copies
    if _better(best, value[0]):
        value[0] = best


def _emitted(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.entries())
    for start in range(0, len(rows), 10_000):
        part = rows[start:start + 10_000]
        yield pa.record_batch([
            pa.array([int.from_bytes(d[:2], "big") for d, _ in part], pa.int32()),
            pa.array([d for d, _ in part], pa.binary()),
            pa.array([v[0][0] for _, v in part], pa.int64()),
            pa.array([v[0][1] for _, v in part], pa.int64()),
            pa.array([v[0][2] for _, v in part], pa.int64()),
            pa.array([v[1] for _, v in part], pa.int64()),
        ], names=["shard", "digest", "keep_points", "keep_id", "keep_row", "copies"])


def _collapse(live_limit: int):
    """Rows of one task to one row per digest; a full index is emitted and begun anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(4096)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("digest", "points", "id", "row")]
            for digest, *best in zip(*columns, strict=True):
                _merge(index, digest, tuple(best), 1)
            if index.live >= live_limit:
                yield from _emitted(index)
                index = CuckooIndex(4096)
        yield from _emitted(index)
    return run


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges rows that arrive sorted by shard; only one shard is held at a time."""
    index, shard = CuckooIndex(), None
    for batch in batches:
        names = ("shard", "digest", "keep_points", "keep_id", "keep_row", "copies")
        for at, digest, points, key, row, copies in zip(
            *[batch.column(c).to_pylist() for c in names], strict=True
        ):
            if at != shard:
                yield from _emitted(index)
                index, shard = CuckooIndex(), at
            _merge(index, digest, (points, key, row), copies)
    yield from _emitted(index)


def live_groups(digests: DataFrame, live_limit: int = 200_000) -> DataFrame:
    """One row per live digest: the row that stays and the number of copies.

    ``digests`` has the columns of `row_digests`. ``live_limit`` bounds the memory of the
    collapse inside each task and changes no result.
    """
    local = digests.mapInArrow(_collapse(live_limit), _GROUP_SCHEMA)
    return (
        local.repartition("digest").sortWithinPartitions("shard")
        .mapInArrow(_merge_shards, _GROUP_SCHEMA)
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, shard = CuckooIndex(), None
    for batch in batches:
        names = ("shard", "kind", "digest", "keep_points", "keep_id", "keep_row", "copies")
        for at, kind, digest, points, key, row, copies in zip(
            *[batch.column(c).to_pylist() for c in names], strict=True
        ):
            if at != shard:
                yield from _emitted(index)
                index, shard = CuckooIndex(), at
            if kind == 1:
                index.delete(digest)
            else:
                _merge(index, digest, (points, key, row), copies)
    yield from _emitted(index)


def apply_changes(
    index: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None
) -> DataFrame:
    """The live digests after deletions, then insertions.

    ``index`` and ``inserts`` have the columns of `live_groups`; ``deletes`` has ``digest``.
    Digests to delete that are not live change nothing.
    """
    names = ["shard", "digest", "keep_points", "keep_id", "keep_row", "copies"]
    steps = index.select(F.lit(0).alias("kind"), *names)
    if deletes is not None:
        steps = steps.unionByName(
            deletes.select("digest").distinct().select(
                F.lit(1).alias("kind"), "digest",
                F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int").alias("shard"),
            ), allowMissingColumns=True,
        )
    if inserts is not None:
        steps = steps.unionByName(inserts.select(F.lit(2).alias("kind"), *names))
    return (
        steps.repartition("digest").sortWithinPartitions("shard", "kind")
        .mapInArrow(_apply, _GROUP_SCHEMA)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, copies included.

    doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256 (of the normalised
    text). An empty table gives no rows; empty and null texts form one group.
    """
    digests = written(row_digests(docs, id_col, text_col), "digests")
    groups = live_groups(digests).select("digest", "keep_id", "keep_row", "copies")
    return digests.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows are found again by digest, length and id; of rows equal in all three, one stays. Rows
    whose digest is certainly not repeated, by a Bloom filter of the repeated ones, stay where they
    lie; only the others are joined.
    """
    digests = written(row_digests(docs, id_col, text_col), "digests")
    groups = written(live_groups(digests), "groups")
    # How many rows share the id and length of the one that stays: more than one is rare.
    ties = (
        digests.groupBy("digest", "points", "id").count().where("count > 1")
        .select("digest", F.col("points").alias("keep_points"), F.col("id").alias("tied_id"))
    )
    best = groups.join(
        ties.withColumn("tied", F.lit(True)),
        (groups.digest == ties.digest) & (groups.keep_points == ties.keep_points)
        & groups.keep_id.eqNullSafe(ties.tied_id), "left",
    ).select(
        groups.digest.alias("_digest"), groups.keep_points.alias("_points"),
        groups.keep_id.alias("_keep"), F.coalesce("tied", F.lit(False)).alias("_tied"),
    )
    text = F.col(f"`{text_col}`")
    rows = docs.select(  # the row as one value, so that no column name can clash
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        text_digest(text).alias("_text_digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_n_points"),
        F.col(f"`{id_col}`").cast("long").alias("_id"),
    )
    repeated = key_filter(groups.where("copies > 1"), columns=["digest"])
    alone = None
    if repeated is not None:
        rows = rows.withColumn("digest", F.col("_text_digest")).withColumn(
            "_maybe", may_match(docs.sparkSession, repeated, ["digest"])).drop("digest")
        alone, rows = rows.where("NOT _maybe").select("_doc.*"), rows.where("_maybe")
    stay = rows.join(
        best,
        (F.col("_text_digest") == F.col("_digest")) & (F.col("_n_points") == F.col("_points"))
        & F.col("_id").eqNullSafe(F.col("_keep")),
    )
    single = stay.where(~F.col("_tied")).select("_doc")
    tied = stay.where("_tied").dropDuplicates(["_text_digest"]).select("_doc")
    stayed = single.unionByName(tied).select("_doc.*")
    return stayed if alone is None else alone.unionByName(stayed)

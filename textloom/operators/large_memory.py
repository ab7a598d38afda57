"""Lookups in a translation memory that is far larger than the batch looked up.

Two ways, to be chosen by how the memory is stored. A memory kept in buckets of its key is joined
where it lies: only the batch is shuffled, into the same buckets. Any other memory is cut first: a
Bloom filter of the batch's keys, sized from their count, passes every row that can match and few
others, so that the shuffle carries about as many rows as the batch has keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.reuse import KEY


# ---- a memory in buckets

def write_bucketed(memory: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Stores ``memory`` as the table ``name`` below ``path``, in sorted buckets of its key.

    Rows are dealt to the buckets before they are written, so each bucket is one file.
    """
    (
        memory.repartition(buckets, *KEY).write.format("parquet").option("path", path)
        .bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
    )
    return open_bucketed(memory.sparkSession, name)


def open_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def lookup_bucketed(blocks: DataFrame, memory: DataFrame) -> DataFrame:
    """Blocks with their stored translation from a table of `write_bucketed`.

    Texts that repeat are looked up once. The memory is neither shuffled nor sorted: the distinct
    keys go to its buckets, and the few rows found go back to the blocks.
    """
    keys = blocks.select(*KEY).distinct()
    found = memory.hint("merge").join(keys, KEY).select(*KEY, "translated_text")
    return blocks.join(found, KEY, "left")


# ---- any memory, cut by a filter

@dataclass(frozen=True)
class KeyFilter:
    """A Bloom filter: ``bits`` positions in words of 64, ``hashes`` of them per key."""

    words: np.ndarray
    bits: int
    hashes: int

    def may_hold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which keys, given as two hash values each, may be in the filter."""
        out = np.ones(len(first), bool)
        a, b = first.view(np.uint64), second.view(np.uint64) | np.uint64(1)
        for i in range(self.hashes):
            at = (a + np.uint64(i) * b) % np.uint64(self.bits)
            word = self.words[(at >> np.uint64(6)).astype(np.int64)]
            out &= (word >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    return F.xxhash64(*columns, F.lit(0)), F.xxhash64(*columns, F.lit(1))


def _positions(bits: int, hashes: int):
    """All words and bits that a task's keys set, each word once per batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a = batch["a"].to_numpy().view(np.uint64)
            b = batch["b"].to_numpy().view(np.uint64) | np.uint64(1)
            at = np.concatenate([
                (a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)
            ] or [np.empty(0, np.uint64)])
            at.sort()
            word = at >> np.uint64(6)
            cut = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(at) else []
            mask = np.uint64(1) << (at & np.uint64(63))
            sets = np.bitwise_or.reduceat(mask, cut) if len(at) else mask
            yield pd.DataFrame({
                "word": word[cut].astype(np.int64), "mask": sets.view(np.int64)})
    return run


def key_filter(
    keys: DataFrame, false_share: float = 0.01, most_bytes: int = 64 << 20,
    columns: Sequence[str] = KEY,
) -> KeyFilter | None:
    """A filter that passes every key of ``keys`` and about ``false_share`` of all others.

    The number of distinct keys is estimated in one pass. Where the filter would take more than
    ``most_bytes`` there is none: a batch of that size is better joined as it is.
    """
    if not 0 < false_share < 1:
        raise ValueError("a share lies between 0 and 1")
    a, b = _hashes(columns)
    hashed = keys.select(a.alias("a"), b.alias("b"))
    count = max(1, int(1.05 * hashed.agg(F.approx_count_distinct("a", 0.02)).first()[0]))
    bits = 64 * math.ceil(-count * math.log(false_share) / math.log(2) ** 2 / 64)
    if bits // 8 > most_bytes:
        return None
    hashes = max(1, round(bits / count * math.log(2)))
    set_ = hashed.mapInPandas(_positions(bits, hashes), "word bigint, mask bigint").groupBy(
        "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[set_["word"].to_numpy()] = set_["mask"].to_numpy().view(np.uint64)
    return KeyFilter(words, bits, hashes)


def may_match(
    spark: SparkSession, passing: KeyFilter, columns: Sequence[str] = KEY
) -> Column:
    """Whether a row's key may be in the filter; only two numbers a row leave the JVM."""
    shared = spark.sparkContext.broadcast((passing.words, passing.bits, passing.hashes))

    @F.pandas_udf(T.BooleanType())
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(KeyFilter(*shared.value).may_hold(a.to_numpy(), b.to_numpy()))

    return held(*_hashes(columns))


def cut_memory(memory: DataFrame, passing: KeyFilter) -> DataFrame:
    """Rows of ``memory`` whose key may be in the filter."""
    return memory.where(may_match(memory.sparkSession, passing))


def lookup_cut(blocks: DataFrame, memory: DataFrame, **options) -> DataFrame:
    """Blocks with their stored translation; the memory is cut by a filter of their keys first."""
    passing = key_filter(blocks, **options)
    rows = memory if passing is None else cut_memory(memory, passing)
    return blocks.join(rows.select(*KEY, "translated_text"), KEY, "left")


def misses_cut(blocks: DataFrame, memory: DataFrame, **options) -> DataFrame:
    """Blocks without a stored translation; the memory is cut by a filter of their keys first."""
    passing = key_filter(blocks, **options)
    rows = memory if passing is None else cut_memory(memory, passing)
    return blocks.join(rows.select(*KEY), KEY, "left_anti")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The characters of `[\x20\x09-\x0D]`, deleted or split at by several contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that all executors share (`spark.checkpoint.dir`).

    Only a session on one machine without that setting, as in tests, gets a local folder;
    a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
    return f"{base.rstrip('/')}/{label}-{os.urandom(6).hex()}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read back by every later use.

    Unlike a cache it survives lost executors, and it cuts the lineage.
    """
    spark = df.sparkSession
    folder = work_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows, so that a worker's memory does
    not depend on the session's setting. Only ever lowers that setting; results are the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The values of a string column; null counts as the empty text."""
    return ["" if v is None else v for v in column.to_pylist()]


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def blocks_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of rows whose sizes add up to ``limit`` or to one larger row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that derived arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole key runs from a stream sorted by ``key``.

    Each table holds one or more complete runs; memory is bounded by one batch and the
    longest run.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        first_of_last = int(runs_of(keys.to_numpy(zero_copy_only=False))[0][-1])
        if waiting and waiting[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if first_of_last > 0:
            yield pa.Table.from_batches([*waiting, batch.slice(0, first_of_last)])
            waiting = []
        waiting.append(batch.slice(first_of_last))
    if waiting:
        yield pa.Table.from_batches(waiting)


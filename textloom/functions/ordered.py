"""Ordered per-key work that survives one key holding a large share of the rows.

A window over ``keys`` alone sends a dominant key to one task. The helpers below cut
every key into buckets of its own order column, work inside (key, bucket), and carry
only one summary row per (key, bucket) across buckets. The bucket must rise with the
order column, so a bucket boundary never reorders rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def span(col: Column, width: int) -> Column:
    """Bucket number of an integer column."""
    return F.floor(col / F.lit(width)).cast("bigint")


def _known(bucket: Column) -> Column:
    # Rows without an order value sort first, so they get the lowest bucket.
    return F.coalesce(bucket.cast("bigint"), F.lit(-(2**62)))


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key. Aggregates map-side, so repeated keys cost no shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """First k rows of every key; Spark keeps k rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


#: Hash slots that keys are dealt to, and rows up to which the keys of a slot are small.
SLOTS, SLOT_ROWS = 1 << 14, 200_000


def small_and_large(
    df: DataFrame, keys: Sequence[str], most: int = SLOT_ROWS, rows: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of small keys, each fit for one task, and all other rows.

    Rows, or the sum of ``rows``, are counted per hash slot of their key, a few numbers per task. A
    key is large where its slot has more than ``most``, so a dominant key always is. Usually there
    is none, and adaptive execution drops what is done with the empty second frame. Null keys are
    in neither.
    """
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    dealt = known.withColumn(
        "_slot", F.xxhash64(F.lit(0), *keys).bitwiseAND(F.lit(SLOTS - 1)))
    size = F.count(F.lit(1)) if rows is None else F.sum(rows)
    large = dealt.groupBy("_slot").agg(size.alias("_n")).where(F.col("_n") > most).select(
        "_slot", F.lit(True).alias("_large"))  # at most SLOTS rows
    # An outer join, as others would be pushed below the exchange that both frames may share.
    marked = dealt.join(F.broadcast(large), "_slot", "left")
    return tuple(marked.where(side).drop("_slot", "_large")
                 for side in ("_large is null", "_large is not null"))


def _with_offsets(
    df: DataFrame, keys: Sequence[str], bucket: Column, summary: Column
) -> DataFrame:
    """``df`` with its bucket and ``_before``: the summary of the key's earlier buckets."""
    marked = df.withColumn(_BUCKET, _known(bucket))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        marked.groupBy(*keys, _BUCKET)
        .agg(summary.alias("_part"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"))
    )
    return marked.join(offsets, [*keys, _BUCKET])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str,
    start: int = 1,
) -> DataFrame:
    """Dense numbering of every key's rows in order."""
    local = F.row_number().over(Window.partitionBy(*keys, _BUCKET).orderBy(*order))
    return (
        _with_offsets(df, keys, bucket, F.count(F.lit(1)))
        .withColumn(name, (F.col("_before") + local + (start - 1)).cast("bigint"))
        .drop(_BUCKET, "_before")
    )


def total_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    bucket: Column,
    name: str,
) -> DataFrame:
    """Sum of ``value`` over the key's rows that come strictly earlier."""
    local = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    valued = df.withColumn("_value", value)
    return (
        _with_offsets(valued, keys, bucket, F.sum("_value"))
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(local), F.lit(0)))
        .drop(_BUCKET, "_before", "_value")
    )


def _edge(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    bucket: Column,
    name: str,
    *,
    forward: bool,
) -> DataFrame:
    marked = df.withColumn("_value", F.struct(value.alias("v"))).withColumn(_BUCKET, _known(bucket))
    pick, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    edges = (
        marked.groupBy(*keys, _BUCKET)
        .agg(pick("_value", F.struct(*order)).alias("_tip"))
        .select(*keys, _BUCKET, shift("_tip").over(across).alias("_carry"))
    )
    inside = shift("_value").over(Window.partitionBy(*keys, _BUCKET).orderBy(*order))
    return (
        marked.join(edges, [*keys, _BUCKET])
        .withColumn(name, F.coalesce(inside, F.col("_carry"))["v"])
        .drop("_value", _BUCKET, "_carry")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column,
    name: str,
) -> DataFrame:
    """``value`` of the key's preceding row, null on its first row."""
    return _edge(df, keys, order, value, bucket, name, forward=False)


def following_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column,
    name: str,
) -> DataFrame:
    """``value`` of the key's next row, null on its last row."""
    return _edge(df, keys, order, value, bucket, name, forward=True)


def surrounding_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str],
    bucket: Column,
) -> DataFrame:
    """``before_<v>`` and ``after_<v>``: the columns ``values`` of the key's rows next to each row.

    Both sides come from one exchange of the rows, and a side that nobody reads does not travel.
    """
    marked = df.withColumn(_BUCKET, _known(bucket))
    row, place = F.struct(*values), F.struct(*order)
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    edges = (
        marked.groupBy(*keys, _BUCKET)
        .agg(F.max_by(row, place).alias("_last"), F.min_by(row, place).alias("_first"))
        .select(*keys, _BUCKET, F.lag("_last").over(across).alias("_before"),
                F.lead("_first").over(across).alias("_after"))
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    sides = {}
    for side, shift in (("before", F.lag), ("after", F.lead)):
        near = shift(F.lit(True)).over(inside)
        for v in values:
            sides[f"{side}_{v}"] = F.when(near, shift(v).over(inside)).otherwise(
                F.col(f"_{side}")[v])
    return marked.join(edges, [*keys, _BUCKET]).withColumns(sides).drop(
        _BUCKET, "_before", "_after")

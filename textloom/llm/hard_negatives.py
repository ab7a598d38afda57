"""Hard negatives by exact inner-product search over candidate lists that clusters of anchors share.

Anchors are clustered by direction. By the angle between a candidate and a cluster's centre, less
the cluster's largest angle, no member's score with that candidate can exceed

    |anchor| * |candidate| * cos(max(0, angle - radius)).

Each cluster therefore sorts the candidates of a task by that bound once, and every member walks the
same list until its own certificate holds: the next bound lies below the worst result it has kept,
so no later candidate can enter. Scores are whole numbers and exact.

Anchors are taken in blocks of bounded size, broadcast one after the other; each block meets all
candidate rows where they lie. A task hands on only results that can still be among the first: an
earlier walk over a small part of the candidates gives every anchor a floor (`_floors`), so what is
shuffled does not grow with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import runs_of, work_folder, written

#: Rows with a null or non-finite component, a null label or a null id take no part.
_ROW = "vec_id long, label int, q array<int>"
_HITS = "anchor_id long, slot long, score long, vec_id long"
_LOWEST = np.iinfo(np.int64).min
_STEP = 512


def _quantised(scale: int, period: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, given = (batch.column(i) for i in range(3))
            ids, given = ids.to_numpy(zero_copy_only=False), given.to_numpy(zero_copy_only=False)
            starts = vectors.offsets.to_numpy().astype(np.int64)
            flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            flat = flat[starts[0]:starts[-1]]  # nulls among the components are NaN here
            starts = starts - starts[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero(bad[starts[1:]] == bad[starts[:-1]])
            whole = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
            if np.abs(whole).max(initial=0) >= 2**31:
                raise ValueError("components of 2^31 / scale or more have no whole-number form")
            lists = pa.ListArray.from_arrays(
                pa.array(starts, pa.int32()),
                pa.array(whole.astype(np.int32)))
            label = np.where(ids % period == 0, np.fmod(given + 1, labels), given)
            yield pa.record_batch([pa.array(ids), pa.array(label.astype(np.int32)), lists],
                                  names=["vec_id", "label", "q"]).take(pa.array(fine))
    return run


def quantised(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", scale: int = 256, period: int = 7, labels: int = 10,
) -> DataFrame:
    """(vec_id, label, q): components as floor(scale * x).

    Labels of rows whose id ``period`` divides move on by one, modulo ``labels``. Rows with a null
    id, label or vector, or a null or non-finite component, are left out.
    """
    return rows.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
        F.col(f"`{label_col}`").cast("int").alias("label"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(
        _quantised(scale, period, labels), _ROW)


# ---- one task's walk

@dataclass
class _Anchors:
    """A block of anchors, sorted by cluster; ``marks`` are the ends of the search per slot."""

    ids: np.ndarray       # (n)
    labels: np.ndarray    # (n)
    q: np.ndarray         # (n, dim) int32
    clusters: np.ndarray  # (n) ascending
    #: (n, slots): a slot's results score at most ``high``, at least ``low``.
    high: np.ndarray
    low: np.ndarray
    #: (n, slots): score and id of the worst result already found elsewhere.
    floor: np.ndarray
    floor_id: np.ndarray
    same_label: bool
    keep: int


def _exact_dtype(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest type in which all inner products of the rows of a and b are exact."""
    most = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` components and whole lengths; shorter rows end in zeros.

    Components beyond ``dim`` meet no component of an anchor; they only lengthen the row.
    """
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(starts)
    square = np.concatenate([[0.0], np.cumsum(flat.astype(np.float64) ** 2)])
    norms = np.sqrt(square[starts[1:]] - square[starts[:-1]])
    if len(lengths) and (lengths == dim).all():
        return flat[starts[0]:starts[-1]].reshape(-1, dim), norms
    out = np.zeros((len(lengths), dim), np.int32)
    for i, (s, n) in enumerate(zip(starts[:-1], np.minimum(lengths, dim), strict=True)):
        out[i, :n] = flat[s:s + n]
    return out, norms


def _unit(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    return q / np.where(norms == 0, 1, norms)


class _Walk:
    """Keeps the best results per anchor and slot over all the rows that a task reads."""

    def __init__(self, anchors: _Anchors):
        self.a = anchors
        n, self.slots = anchors.high.shape
        self.unit = _unit(anchors.q)
        self.norms = np.linalg.norm(anchors.q.astype(np.float64), axis=1)
        self.best = np.full((n, self.slots, anchors.keep), _LOWEST, np.int64)
        self.best_id = np.zeros((n, self.slots, anchors.keep), np.int64)
        # Centre and cosine of the radius of each cluster.
        self.groups = []
        for s, e in zip(*runs_of(anchors.clusters), strict=True):
            centre = self.unit[s:e].sum(0)
            length = np.linalg.norm(centre)
            centre = centre / length if length else np.eye(1, len(centre))[0]
            radius = np.arccos(np.clip(self.unit[s:e] @ centre, -1, 1)).max()
            self.groups.append((s, e, centre, radius))

    def over(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, norms: np.ndarray) -> None:
        unit = _unit(q)
        kind = _exact_dtype(self.a.q, q)
        rows, own = q.astype(kind), self.a.q.astype(kind)
        for s, e, centre, radius in self.groups:
            angle = np.arccos(np.clip(unit @ centre, -1, 1))
            # The small part makes up for rounding of angles and norms.
            bound = norms * np.minimum(1, np.cos(np.maximum(angle - radius, 0)) + 1e-6) + 1e-6
            order = np.argsort(-bound, kind="stable")
            self._members(np.arange(s, e), own, ids, labels, rows, order, bound[order])

    def _worst(self, members: np.ndarray) -> np.ndarray:
        """Scores below these cannot enter a slot; one past the top for slots without a range."""
        return np.maximum(np.maximum(self.best[members, :, -1], self.a.floor[members]),
                          self.a.low[members])

    def _members(self, active, own, ids, labels, rows, order, bound) -> None:
        for at in range(0, len(order), _STEP):
            worst = self._worst(active)
            open_ = (worst <= (self.norms[active] * bound[at])[:, None]) & (
                self.a.low[active] <= self.a.high[active])
            active, worst = active[open_.any(1)], worst[open_.any(1)]
            if not len(active):
                return
            part = order[at:at + _STEP]
            scores = (own[active] @ rows[part].T).astype(np.int64)
            fits = (self.a.labels[active, None] == labels[part]) == self.a.same_label
            fits &= self.a.ids[active, None] != ids[part]
            for slot in range(self.slots):
                use = fits & (scores >= worst[:, slot, None]) & (
                    scores <= self.a.high[active, slot, None])
                who, what = np.nonzero(use)
                if len(who):
                    self._enter(active[who], slot, scores[who, what], ids[part[what]])

    def _enter(self, who, slot, scores, found) -> None:
        floor, floor_id = self.a.floor[who, slot], self.a.floor_id[who, slot]
        better = (scores > floor) | (found <= floor_id)
        who, scores, found = who[better], scores[better], found[better]
        touched = np.unique(who)
        keep = self.a.keep
        old, old_id = self.best[touched, slot], self.best_id[touched, slot]
        who = np.concatenate([who, np.repeat(touched, keep)])
        scores = np.concatenate([scores, old.ravel()])
        found = np.concatenate([found, old_id.ravel()])
        order = np.lexsort((found, ~scores, who))  # ~ reverses whole numbers
        who, scores, found = who[order], scores[order], found[order]
        starts, ends = runs_of(who)
        rank = np.arange(len(who)) - np.repeat(starts, ends - starts)
        first = rank < keep
        self.best[touched, slot] = scores[first].reshape(-1, keep)
        self.best_id[touched, slot] = found[first].reshape(-1, keep)

    def hits(self) -> pa.RecordBatch:
        who, slot, k = np.nonzero(self.best > _LOWEST)
        return pa.record_batch([
            pa.array(self.a.ids[who]), pa.array(slot.astype(np.int64)),
            pa.array(self.best[who, slot, k]), pa.array(self.best_id[who, slot, k])],
            names=["anchor_id", "slot", "score", "vec_id"])


def _search(shared, list_rows: int):
    """Walks over the rows of a task in lists of about ``list_rows`` candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, waiting, n = None, [], 0

        def flush() -> None:
            nonlocal waiting, n
            parts = [_matrix(b.column(2), walk.a.q.shape[1]) for b in waiting]
            ids, labels = (np.concatenate([
                b.column(i).to_numpy(zero_copy_only=False) for b in waiting]) for i in (0, 1))
            walk.over(ids, labels, np.concatenate([p[0] for p in parts]),
                      np.concatenate([p[1] for p in parts]))
            waiting, n = [], 0

        for batch in batches:
            if walk is None:
                walk = _Walk(_Anchors(**shared.value))
            waiting.append(batch)
            n += batch.num_rows
            if n >= list_rows:
                flush()
        if walk is not None:
            if n:
                flush()
            yield walk.hits()
    return run


# ---- all tasks

def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``count`` clusters of the rows of ``sample`` (spherical k-means)."""
    unit = _unit(sample)
    centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _nearest(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([
        np.argmax(_unit(q[i:i + 4096]) @ centres.T, 1) for i in range(0, len(q), 4096)
    ] or [np.empty(0, np.int64)]).astype(np.int64)


def _clustered(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = _nearest(_matrix(batch.column(2), centres.shape[1])[0], centres)
            yield pa.record_batch([*batch.columns, pa.array(nearest)],
                                  names=["vec_id", "label", "q", "cluster"])
    return run


def _first(hits: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(
        Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= keep)


def _run(rows: DataFrame, anchors: _Anchors, list_rows: int, floors: list[DataFrame]) -> DataFrame:
    """The first results per anchor and slot (anchor_id, slot, score, vec_id, rank)."""
    context = rows.sparkSession.sparkContext
    at = {int(a): i for i, a in enumerate(anchors.ids)}
    for part in floors:
        shared = context.broadcast(vars(anchors))
        found = _first(part.mapInArrow(_search(shared, list_rows), _HITS), anchors.keep).where(
            F.col("rank") == anchors.keep).toArrow()
        who = np.array([at[a] for a in found["anchor_id"].to_pylist()], np.int64)
        slot = found["slot"].to_numpy()
        anchors.floor[who, slot] = found["score"].to_numpy()
        anchors.floor_id[who, slot] = found["vec_id"].to_numpy()
        shared.destroy()
    shared = context.broadcast(vars(anchors))
    return _first(rows.mapInArrow(_search(shared, list_rows), _HITS), anchors.keep)


def _floors(rows: DataFrame, count: int, list_rows: int) -> list[DataFrame]:
    """Quarters of quarters of the candidates, smallest first: each walk needs to hand on only what
    beats the one before, some four times as many rows as are kept, in however many tasks."""
    parts, share = [], 4
    while count // share * 4 > list_rows:
        parts.append(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0))
        share *= 4
    return parts[::-1]


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
    low_percent: int = 80, block: int = 32_768, cluster_size: int = 64,
    sample: int = 16_384, list_rows: int = 16_384, most_clusters: int = 512,
) -> DataFrame:
    """Hard negatives of every anchor and positive, from rows as `quantised` gives them.

    Anchors are rows whose id ``every`` divides. A row's score is its inner product with the anchor;
    higher scores come first, then smaller ids. Positives are an anchor's first rows of its label,
    negatives its first rows of other labels that score ``low_percent`` to 100 percent of the
    positive's score, so a negative score of a positive leaves none.

    Rows with an anchor's own id are never its results. A repeated id is one anchor, with the row of
    the smallest label and components; as candidates repeated rows count each. Vectors of unequal
    length meet in their common components. Anchors without positives give no rows, an empty table
    gives none.

    ``block`` anchors are broadcast at a time: 4 bytes per component and some 250 bytes each. The
    centres of the clusters come from at most ``sample`` anchors; they decide what is skipped, never
    the result.
    """
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    chosen = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")
    folder = work_folder(spark, "negatives")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    spark.createDataFrame([], schema).write.parquet(folder)
    count, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    n_anchors = chosen.count()
    if n_anchors and dim and dim > 0:
        few = chosen.orderBy(F.xxhash64("vec_id")).limit(sample).toArrow()
        fitted = _matrix(few["q"].combine_chunks(), dim)[0]
        clusters = min(-(-n_anchors // cluster_size), len(fitted), most_clusters)
        numbered = written(
            chosen.mapInArrow(_clustered(_centres(fitted, clusters)), f"{_ROW}, cluster long")
            .repartitionByRange("cluster", "vec_id").sortWithinPartitions("cluster", "vec_id"),
            "anchors")
        for part in _anchor_blocks(numbered, n_anchors, block):
            _one_block(rows, part, dim, _floors(rows, count, list_rows), positives, negatives,
                       low_percent, list_rows, cluster_size, most_clusters).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _anchor_blocks(anchors: DataFrame, count: int, block: int) -> Iterator[pa.Table]:
    """Anchors in blocks of at most ``block`` rows, near ones together."""
    if count <= block:
        yield anchors.toArrow()
        return
    sizes = {r[0]: r[1] for r in anchors.groupBy("cluster").count().collect()}  # one per cluster
    first, total = None, 0
    ranges = []
    for cluster in sorted(sizes):
        if sizes[cluster] > block:  # a crowded cluster is cut by a hash of the id
            parts = 2 * -(-sizes[cluster] // block)
            if first is not None:
                ranges.append((F.col("cluster") >= first) & (F.col("cluster") < cluster))
            ranges += [(F.col("cluster") == cluster)
                       & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p) for p in range(parts)]
            first, total = None, 0
            continue
        if first is None or total + sizes[cluster] > block:
            if first is not None:
                ranges.append((F.col("cluster") >= first) & (F.col("cluster") < cluster))
            first, total = cluster, 0
        total += sizes[cluster]
    if first is not None:
        ranges.append(F.col("cluster") >= first)
    for condition in ranges:
        part = anchors.where(condition).toArrow()
        if part.num_rows:
            yield part


def _one_block(rows, part, dim, floors, positives, negatives, low_percent, list_rows,
               cluster_size, most_clusters) -> DataFrame:
    q = _matrix(part["q"].combine_chunks(), dim)[0]
    n, top = len(q), np.iinfo(np.int64).max
    few = q[::-(-n // 8192)]
    clusters = _nearest(q, _centres(few, min(-(-n // cluster_size), most_clusters, len(few))))
    order = np.argsort(clusters, kind="stable")
    clusters, q = clusters[order], q[order]
    ids, labels = (part[c].to_numpy()[order] for c in ("vec_id", "label"))

    def limits(high: np.ndarray, low: np.ndarray, same: bool, keep: int) -> _Anchors:
        return _Anchors(ids, labels, q, clusters, high, low,
                        np.full(high.shape, _LOWEST), np.full(high.shape, top), same, keep)

    found = written(_run(rows, limits(
        np.full((n, 1), top), np.full((n, 1), _LOWEST), True, positives), list_rows, floors
    ).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias(
        "positive_score"), (F.col("rank") - 1).cast("long").alias("slot")), "positives")
    scores = found.select("anchor_id", "slot", "positive_score").toArrow()  # a block's, bounded
    at = {int(a): i for i, a in enumerate(ids)}
    who = np.array([at[a] for a in scores["anchor_id"].to_pylist()], np.int64)
    slot, score = scores["slot"].to_numpy(), scores["positive_score"].to_numpy()
    # A slot that has no positive, or one below zero, has an empty range.
    high, low = np.full((n, positives), -1), np.zeros((n, positives), np.int64)
    use = score >= 0
    high[who[use], slot[use]] = score[use]
    low[who[use], slot[use]] = -(-score[use] * low_percent // 100)
    # Positives of equal score have the same negatives: only the first of them is searched.
    again = high[:, 1:] == high[:, :-1]
    high[:, 1:] = np.where(again, -1, high[:, 1:])
    best = _run(rows, limits(high, low, False, negatives), list_rows, floors)
    source = F.min("slot").over(Window.partitionBy("anchor_id", "positive_score"))
    return found.withColumn("source", source).join(best.select(
        "anchor_id", F.col("slot").alias("source"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank")),
        ["anchor_id", "source"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

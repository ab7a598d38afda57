"""A Merkle manifest of a data set: one root over all rows, and a proof for every row.

Rows are leaves. Per group (the language) leaves ascend by id, and every 8 consecutive nodes become
their parent until one is left, the group's root; the groups' roots, in order, become the root in
the same way.

A level of nodes is kept as one string of hex digests, 64 characters each, per block of 512 leaves
that starts at a multiple of 512. Inside a block, parents are digests of substrings of 512
characters, and the siblings of a node are what flanks it in its own substring. The top nodes of
the blocks are the leaves of the next round, so no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.llm.common import written

#: Fixed values of the format: nodes per parent, characters per digest, levels per block.
FAN, DIGEST, LEVELS = 8, 64, 3
_RUN = FAN * DIGEST

#: What stands left and right of a node among its siblings, from the leaf's level upwards.
PATH = "array<struct<left: string, right: string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 length, a colon and its text; ``-`` where null."""
    return F.sha2(F.concat(*[
        F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
        for c in (f.cast("string") for f in fields)
    ]), 256)


def _parents(level: Column) -> Column:
    """The next level's string: digests of runs of eight nodes, the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / _RUN).cast("int") - 1)
    return F.array_join(F.transform(
        runs, lambda j: F.sha2(F.substring(level, j * _RUN + 1, F.lit(_RUN)), 256)), "")


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``total`` within ``grp`` in the given order.

    Ranges over group and order are written with their number; only one count per group and range
    crosses ranges, so a group of any size is spread.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = written(
        rows.repartitionByRange("grp", *keys).withColumn("_range", F.spark_partition_id()),
        "ranges")
    before = Window.partitionBy("grp").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = placed.groupBy("grp", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "grp", "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("grp")).alias("total"))
    inside = F.row_number().over(Window.partitionBy("grp", "_range").orderBy(*keys))
    return (
        placed.withColumn("_inside", inside).join(counts, ["grp", "_range"])
        .withColumn("pos", (F.col("_before") + F.col("_inside") - 1).cast("long"))
        .drop("_range", "_before", "_inside")
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes`` (grp, pos, total, hash, item): its levels and its top node."""
    size = FAN ** LEVELS
    gathered = nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block")).agg(
        F.first("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("pos", "hash", "item"))).alias("rows"))
    levels = gathered.select(
        "grp", "block", "total", F.transform("rows", lambda r: r["item"]).alias("items"),
        F.array_join(F.transform("rows", lambda r: r["hash"]), "").alias("l0"))
    top = F.col("l0")
    for i in range(LEVELS):
        # A group of one block ends at its single node; with more blocks, all levels are needed.
        levels = levels.withColumn(
            f"l{i + 1}", F.when(F.col("total") > FAN ** i, _parents(F.col(f"l{i}"))))
        top = F.coalesce(F.col(f"l{i + 1}"), top)
    return levels.withColumn("top", top)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round, each written; the last has one block per group."""
    rounds = [written(_blocks(nodes), "blocks")]
    most = rounds[0].agg(F.max("block")).first()[0] or 0
    while most > 0:
        below = rounds[-1]
        rounds.append(written(_blocks(below.select(
            "grp", F.col("block").alias("pos"),
            F.ceil(F.col("total") / FAN ** LEVELS).cast("long").alias("total"),
            F.col("top").alias("hash"), F.lit(None).cast("string").alias("item"))), "blocks"))
        most //= FAN ** LEVELS
    return rounds


def _step(level: Column, at: Column) -> Column:
    """Left and right siblings of node ``at`` in a level's string."""
    run = F.substring(level, F.floor(at / FAN).cast("int") * _RUN + 1, F.lit(_RUN))
    own = F.pmod(at, F.lit(FAN)) * DIGEST
    return let(run, lambda r: F.struct(
        F.substring(r, F.lit(1), own).alias("left"),
        F.substring(r, own + DIGEST + 1, F.lit(_RUN)).alias("right")))


def _unfold(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Every node of ``blocks`` with its path to the root.

    ``above`` has (grp, block, up): the path of each block's top node. A block's nodes are made as
    one array, so that its level strings are not copied for every node.
    """
    runs = F.transform(
        F.sequence(F.lit(0), F.ceil(F.length("l0") / _RUN).cast("int") - 1),
        lambda j: F.substring(F.col("l0"), j * _RUN + 1, F.lit(_RUN)))
    joined = blocks.join(above, ["grp", "block"]).withColumn("runs", runs)

    def node(item: Column, i: Column) -> Column:
        run, own = F.col("runs")[F.floor(i / FAN).cast("int")], F.pmod(i, F.lit(FAN)) * DIGEST
        steps = [F.struct(
            F.substring(run, F.lit(1), own).alias("left"),
            F.substring(run, own + DIGEST + 1, F.lit(_RUN)).alias("right"))]
        steps += [_step(F.col(f"l{k}"), F.floor(i / FAN ** k).cast("int"))
                  for k in range(1, LEVELS)]
        path = F.concat(
            F.array_compact(F.array(*[
                F.when(F.col("total") > FAN ** k, step) for k, step in enumerate(steps)])),
            F.col("up"))
        return F.struct(
            (F.col("block") * FAN ** LEVELS + i).alias("pos"), item.alias("item"),
            F.substring(run, own + 1, F.lit(DIGEST)).alias("hash"), path.cast(PATH).alias("path"))

    return joined.select("grp", F.inline(F.transform("items", node)))


def _paths(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(grp, pos, item, hash, path) of the leaves; ``ends`` has (grp, up) of each group's root."""
    above = rounds[-1].select("grp", "block").join(ends, "grp")
    for blocks in reversed(rounds[1:]):
        above = _unfold(blocks, above).select(
            "grp", F.col("pos").alias("block"), F.col("path").alias("up"))
    return _unfold(rounds[0], above)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(
        F.concat(step["left"], h, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf's level upwards, left to right."""
    return F.sha2(F.array_join(
        F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def proofs(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang", id_col: str = "doc_id", changed: Column | None = None,
) -> DataFrame:
    """id, leaf, changed_leaf, subroot, root and path (siblings up to the root) of every row.

    ``fields`` make up a leaf. ``changed`` replaces the last field in ``changed_leaf`` (null where
    ``changed`` is null): the leaf of a copy that shall be held against the manifest. A null group
    comes first and is a group of its own, null ids come first in it, rows with equal ids follow
    their leaves, and equal rows are separate leaves. An empty table has no rows and no root.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    other = F.lit(None).cast("string") if changed is None else F.when(
        changed.isNotNull(), leaf_digest([*columns[:-1], changed]))
    group = F.col(f"`{group_col}`").cast("string")
    leaves = written(docs.select(
        # Sorts before all others where null.
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("grp"),
        F.col(f"`{id_col}`").cast("long").alias("id"), leaf_digest(columns).alias("hash"),
        other.alias("changed_leaf")), "leaves")
    rounds = _rounds(_numbered(leaves, ["id", "hash"]).select(
        "grp", "pos", "total", "hash", F.struct("id", "changed_leaf").alias("item")))
    subroots = rounds[-1].select("grp", F.col("top").alias("subroot"))
    over = _rounds(_numbered(
        subroots.select(F.lit("").alias("grp"), F.col("grp").alias("item"),
                        F.col("subroot").alias("hash")), ["item"]))
    found = over[-1].select("top").first()
    ends = _paths(over, F.broadcast(docs.sparkSession.range(1).select(
        F.lit("").alias("grp"), F.array().cast(PATH).alias("up")))).select(
            F.col("item").alias("grp"), F.col("path").alias("up"))
    return _paths(rounds, ends).join(subroots, "grp").select(
        F.col("item.id").alias("id"), F.col("hash").alias("leaf"),
        F.col("item.changed_leaf").alias("changed_leaf"), "subroot",
        F.lit(found and found[0]).cast("string").alias("root"), "path")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def verified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of ``docs``, held against a copy that was tampered with.

    Rows whose id's decimal text has an unsigned crc32 that 3 divides are tampered with: their text
    is lower-cased (A-Z). Null ids and null texts stay untouched. doc_id, leaf, subroot, root and
    proof_sha256 are those of ``docs``; folded_root is what the copy's leaf gives with the same
    siblings, and verified whether it is the root.
    """
    touched = F.crc32(F.col(f"`{id_col}`").cast("long").cast("string")) % 3 == 0
    rows = proofs(docs, ("doc_id", "source", "lang", "n_chars", text_col), "lang", id_col,
                  F.when(touched, lower_ascii(F.col(f"`{text_col}`"))))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Alternates two star steps: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones, until all links are stars around the smallest node.
    The number of rounds grows with the logarithm of a component's size, and neither step makes
    more links than it reads. Each round is written to the shared folder, so a lost executor
    costs no more than its own part of a round.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b").distinct(), "links",
    )
    while True:
        # Large star: neighbours larger than the node take its smallest neighbour (or itself).
        both = edges.select("a", "b").unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .where("a != b").distinct()
        )
        # Small star: smaller neighbours and the node itself take the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lowest, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
                    .alias("a"), F.col("low").alias("b"))
            .where("a != b").distinct()
        )
        after = written(small, "stars")
        # Stars only: no node is both a centre and a leaf, and no leaf has two centres.
        centres = after.select(F.col("b").alias("a")).distinct()
        open_ = after.join(centres, "a", "left_semi").limit(1).count() or (
            after.groupBy("a").count().where("count > 1").limit(1).count()
        )
        edges = after
        if not open_:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

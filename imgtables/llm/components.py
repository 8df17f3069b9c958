"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _digest(edges: DataFrame):
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") == F.col("v")).cast("int"))
    ).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node, the smallest of itself and its neighbours; an aggregation, so hubs are combined map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; label is the component's smallest node.

    Each round shuffles the edges a constant number of times, and the number of rounds grows
    with the logarithm of the longest path. No node's neighbours meet in one row, and joins
    on hubs can be split. Every round is a table in the checkpoint folder.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node point to the smallest of its neighbourhood
        large = (
            both.join(_smallest(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: a node and its smaller neighbours point to the smallest of them
        joined = large.join(_smallest(large), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )

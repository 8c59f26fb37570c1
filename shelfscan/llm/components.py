"""Connected components by alternating large-star and small-star steps.

Each step is one map-side combined minimum and one equality join, so a hub is never gathered
in a group; after a logarithmic number of steps every node points at the least node of its
component. Edges are cut to the shared checkpoint folder after each pair of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least.select("a", F.least("a", "m").alias("m")), "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points from the larger node to the smaller one here.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (
        edges.join(least, "a")
        .filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its least node.

    ``edges``: two columns of one orderable type, in either direction, repeats and loops
    allowed, nulls not. Nodes without edges do not appear.
    """
    first, second = edges.columns
    current = cut(
        edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
        .filter("a <> b")
        .distinct()
    )
    before = _state(current)
    while before[0]:
        current = cut(_small_star(_large_star(current)))
        now = _state(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.union(current.select(F.col("a").alias("node"), F.col("b").alias("component")))

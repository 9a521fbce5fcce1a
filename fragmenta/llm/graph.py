"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest of each node's neighbours and itself. Sums up before it shuffles, so a node of many edges is no burden."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs; the component is its smallest node.

    Alternates two contractions until edges no longer change: each node's larger neighbours move to its smallest
    neighbour, then its smaller neighbours do. Rounds grow with the logarithm of the longest path. Loops, repeated edges and
    null ends are left out. Everything stays in tables; the driver sees two sums a round.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(tidy(edges), "edges"), None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == before or not mark[0]:
            break
        before = mark
        around = both(edges)
        least = materialize(_least(around), "least")
        large = around.filter("b > a").join(least, around.a == least.node).select(F.col("b").alias("a"), F.col("least").alias("b"))
        old, edges = (edges, least), materialize(tidy(large), "large_star")
        free(*old)
        least = materialize(_least(edges), "least")
        small = edges.join(least, edges.a == least.node)
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
        old, edges = (edges, least), materialize(tidy(small), "small_star")
        free(*old)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

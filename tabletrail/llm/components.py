"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrail.sources.scratch import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to its least neighbour, or to itself if it is less."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of them. Edges are (a, b) with a < b, so b is the node."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least.hint("merge"), "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (a, b) the least node it is connected with. Self-loops are ignored.

    Minima are aggregated before they are joined, so a node with very many edges is no single task's work. Each round is
    written to the shared folder; rounds grow with the logarithm of the graph's diameter. Stored edges take less room than the
    same rows in memory, so Spark is not left to broadcast them by their files' size.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        new = written(_small_star(_large_star(now)), "edges")
        new_mark = _mark(new)
        if new_mark == mark:
            break
        now, mark = new, new_mark
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

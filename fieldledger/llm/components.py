"""Connected components by alternating stars: every step is two aggregations and two joins on the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node that points nowhere."""
    inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return inner.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): each node that has an edge with the smallest node it can reach.
    Nulls and loops are no edges; repeated and reversed edges count once. No edges give no rows."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "edges")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges)), "star")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(edges.select(F.col("b"), F.col("b")).distinct())

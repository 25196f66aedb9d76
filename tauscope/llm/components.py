"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauscope.llm.common import stash


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with one neighbour below it to one with none, that is, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    known = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return known.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, long): root is the smallest node it can reach.

    Every step takes the smallest neighbour by a map-side combined minimum and hands it to all
    neighbours by a join, so the centre of a star is never gathered anywhere. The number of steps
    grows with the logarithm of the number of nodes. An empty table gives an empty table; loops
    and repeated edges change nothing.
    """
    edges = stash(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

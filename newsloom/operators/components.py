"""Connected components of a graph of pairs, in rounds whose number grows with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of ``pairs`` (a, b); the component is its least node. Nodes may be of any type with an order.

    Large and small stars in turn: each node hands the least of its neighbours to those above it, then to those below, until
    every edge leads from a node to its component's least. A node of many neighbours is a group of a minimum, and never gathered.
    """
    edges = checkpoint(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (now := _summed(edges)) != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(lower.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _summed(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; a graph of stars stays as it is."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

"""Connected components of a link table by alternating stars; every step is a Spark join, nothing gathers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

TASK_LINKS = 100_000


def few(rows: DataFrame, n: int) -> DataFrame:
    """In as many parts as ``n`` small rows need, where a shuffle left more: each part would be a file, in every round."""
    return rows.coalesce(max(1, -(-n // TASK_LINKS)))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being the smallest node reachable.

    Large and small stars alternate until nothing changes, in about log(longest chain) rounds. Each round is checkpointed,
    so lineage stays short and a lost executor costs no earlier round. Null ends and loops are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = checkpoint(edges)
    state = _state(edges)
    while True:
        n = 2 * state[0]  # links never grow in number
        edges = few(edges, n)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(few(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), n))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpoint(few(large, n))
        least = checkpoint(few(large.groupBy("a").agg(F.min("b").alias("m")), n))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(few(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), n))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

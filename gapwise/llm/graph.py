"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import checkpoint


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); a component is named by its smallest node.

    Each round joins nodes with the smallest of their neighbours, an aggregate that combines before its shuffle, so
    that a hub's neighbours are never together in a task. Self-loops and repeated edges are allowed; an empty table
    gives an empty result. Rounds grow with the logarithm of the longest path; not ending within most_rounds is an error.
    """
    edges = checkpoint(edges.select("a", "b").filter("a != b").distinct())
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # large-star: every larger neighbour of a node points to the node's smallest
        large = checkpoint(large.filter("a != b").distinct())
        # small-star: a node and its smaller neighbours point to the smallest of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        own = large.join(small, "a")
        edges = checkpoint(own.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

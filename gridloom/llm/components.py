"""Connected components of a sparse graph by alternating large and small stars.

Each round is two joins and aggregations over the edges alone; a written table
cuts the lineage after it. The edges shrink to stars around the least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``: the least node that each linked node reaches."""
    edges = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        # Stars only: no low end of an edge is the high end of another.
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).collect()[0]
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour, itself included."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    larger = edges.select(F.col("a").alias("high"), F.col("b").alias("a"))
    return larger.join(least, "a").select(F.col("high").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    own = least.select("a", F.col("root").alias("b"))
    return tied.union(own).where(F.col("a") != F.col("b")).distinct()

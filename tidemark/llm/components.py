"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the component is its smallest node.

    Large star: each node ties its larger neighbours to its smallest neighbour. Small star: it ties its smaller ones
    and itself to it. A round joins on nodes with plain joins, whose hot keys Spark can split, and with partial minima;
    the number of rounds is logarithmic in the number of nodes. Edges from a node to itself count for nothing.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = None
    while (found := mark(now)) != before and found[0]:
        before = found
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

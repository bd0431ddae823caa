"""Connected components by alternating stars (Kiveris et al., SoCC 2014).

Every round rewrites the edges so that nodes point to smaller ones; the rounds needed
grow with the logarithm of the graph's size. Each round's edges are written to the
shared folder, so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours point to its least neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, point to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of pairs (a, b); component is the least node of its own.

    Nodes are of any type with an order. Pairs may repeat, in both directions; those of a
    node with itself are left out, and null ones too.
    """
    edges = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "star")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

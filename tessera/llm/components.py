"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node (above it: large, else not above it) to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = both if large else both.where(F.col("b") < F.col("a"))
    least = own.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    found = own.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).select("a", "b", "m")
    if large:
        out = found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = found.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs): root is the least node of its component.

    Each round is written, so a round survives lost executors; rounds grow with the logarithm of the
    longest path. A node with many neighbours costs rows in proportion; no pairs of neighbours arise.
    """
    now = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
        if sign == mark or not sign["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = sign
        now = materialize(_star(_star(now, True), False))

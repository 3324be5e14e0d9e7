"""Connected components by alternating large and small stars, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import discard, lookup, staged


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, in any direction, repeats allowed. Result (node, root): root is the least node reachable; isolated nodes are absent.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour; the
    number of rounds is about the logarithm of the longest path. A node with very many edges is no hot key: its row is
    found by a broadcast of the few heavy nodes. Each round's edges are staged.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = staged(spark, edges, "cc-edges")
    before = None
    while True:
        # large star: a node's larger neighbours go to the least of the node and its neighbours
        both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionByName(edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        moved = lookup(both, least, "v", "n").where("w > v").select(F.col("w").alias("hi"), F.col("m").alias("lo"))
        last, edges = edges, staged(spark, moved.where("hi <> lo").distinct(), "cc-large")
        discard(spark, last)
        # small star: a node and its smaller neighbours go to the least of them
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        found = lookup(edges, least, "hi", "n")
        moved = found.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        last, edges = edges, staged(spark, moved.where("hi <> lo").distinct(), "cc-small")
        discard(spark, last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = state

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import drop, table


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for every node that has an edge.

    Each step sums up neighbours with groupBy (partial aggregation, so that a hub node isn't gathered in one task)
    and is written to the shared folder, where the tables of the step before are deleted. The number of steps follows the logarithm of the longest chain. Self
    loops, repeated edges and either direction are fine; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = table(spark, pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(spark, large.where("u <> v").distinct(), "large")
        down = table(spark, large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        new = table(spark, small.distinct(), "small")
        # every node but the roots points at one root, and no root points anywhere: done
        state = new.select(F.count("*").alias("n"), F.countDistinct("u").alias("k"))
        roots = new.select(F.col("v").alias("u")).distinct()
        deeper = new.join(roots, "u", "left_semi").isEmpty()
        row = state.first()
        drop(pairs, least, large, down)
        pairs = new
        if deeper and row.n == row.k:
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

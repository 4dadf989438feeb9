"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step is a combining minimum for each node and an equi-join, so a node with very many neighbours is pre-aggregated
and the join may be split; edges and labels never leave the executors. Steps are written to the shared folder, so a lost
executor costs one step. Ends when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, materialize


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(u, v) undirected -> (node, component: the smallest node it reaches), for nodes with an edge to another node."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    while True:
        # Large star: the greater neighbours of a node join the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lesser neighbours join the least of them.
        old, large = now, materialize(large, label)
        discard(old)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), label)
        discard(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state

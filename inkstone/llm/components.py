"""Connected components by alternating large and small stars, all in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), two longs; component is the smallest node that links reach.

    Each round turns edges towards the smallest neighbour; rounds grow with the logarithm of the longest path. A hub is
    a hot key of a plain sort-merge join, which adaptive execution splits; minima are pre-aggregated before a shuffle.
    Null ends and loops are dropped; no edges give no rows.
    """
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large)
        scratch.drop(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.write(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(large)

"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.storage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and self-loops
    do not matter, rows with a null are ignored. Returns ``node`` and
    ``component`` (the smallest node reachable), one row per node. Every step is
    an aggregation with map-side combining and a join back, so a hub is never
    gathered in one task; the edge list is cut from its lineage each round by a
    reliable checkpoint. Rounds go on until none changes the edges; their number
    grows with the logarithm of the longest path.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tidy = cut(tidy)
    before = None
    while True:
        both = tidy.unionByName(tidy.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        tidy = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tidy.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = tidy.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = tidy.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))

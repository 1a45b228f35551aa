"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links``.

    Each round is two aggregations and two joins; the number of rounds grows
    with the logarithm of the longest path. Nothing is collected but a count.
    """
    edges = written(links.filter(f"{a} <> {b}").select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "cc-edges")
    before = None
    while True:
        # large-star: every larger neighbour of a node links to the node's smallest
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        # small-star: every node links its smaller neighbours and itself to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("l"), F.col("lo").alias("h")).union(least.select(F.col("m").alias("l"), F.col("hi").alias("h")))
        edges = written(small.filter("l <> h").select(F.col("l").alias("lo"), F.col("h").alias("hi")).distinct(), "cc-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())

"""Connected components by alternating large-star and small-star, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges u > v. The minima are written, so that a hot node's edges can be split in the joins."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
    large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large_star")
    low = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
    moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    for t in (least, large, low):
        drop_written(t)
    return out


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) between longs: node, root for each node with an edge to another; root is the least node of its component."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(e)
    while before[0]:
        nxt = _round(e)
        drop_written(e)
        e, now = nxt, state(nxt)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())

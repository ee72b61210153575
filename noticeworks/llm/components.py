"""Connected components by alternating large and small stars, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (u, v longs): component is the smallest node reachable.

    Each round hooks neighbours to the least node they know, first the larger ones, then the smaller ones, until
    the edges are stars. A node's neighbours are never listed: each step is a minimum a node (combined before the
    shuffle) and a join on the node, which adaptive execution splits when one node has many edges.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(e)) != before and now[0]:
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        )
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

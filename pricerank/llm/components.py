"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of the links (a, b); nulls and loops count for nothing.

    Each step hangs nodes on the least neighbour; every edge set is stored, so no lineage grows. A star, as leaders make it, is done at once. What is joined to the edges
    of a node is stored as well, so that Spark may split the edges of a node that has many.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while seen != (state := _state(edges)):
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        edges = stored(small.distinct())
    pairs = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stored(pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct()))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

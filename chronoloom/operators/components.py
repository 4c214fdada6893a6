"""Connected components by star contraction, for record-key graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise


def _rounds(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
    return small.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs: (node, component), the component being the smallest node.

    Every round is written as a table; the links are compared by a count and a sum of
    hashes, so nothing else reaches the driver.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before, now = mark, materialise(_rounds(now))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def led_components(edges: DataFrame) -> DataFrame:
    """The same for edges (a, b) in which b leads the stars that a is in; where every node has one lead no rounds are needed."""
    leads = materialise(edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
    if leads.where("low <> high").isEmpty():
        return leads.select(F.col("a").alias("node"), F.col("low").alias("component"))
    return connected_components(leads.select("a", F.col("low").alias("b")).union(edges.join(leads.where("low <> high"), "a", "left_semi").select("a", "b")))


def label(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes`` (record_id) with their cluster_id; a node without links is its own."""
    found = components.select(F.col("node").alias("record_id"), F.col("component").alias("_c"))
    return nodes.select("record_id").join(found, "record_id", "left").select("record_id", F.coalesce("_c", "record_id").alias("cluster_id"))

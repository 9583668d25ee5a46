"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import cut


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round moves every link towards the smallest node known; it ends when
    all links are stars around the smallest node. Rounds grow with the
    logarithm of the longest path. Minima are aggregated on the map side, and
    every round is written to the shared folder."""
    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
            "links")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("a"))
        large = both.where("v > u").join(low, "u").select("a", F.col("v").alias("b")).where("a < b").distinct()
        large = cut(large, "large-star")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(
            joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        e = cut(small, "small-star")
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest node next to it: the larger
    neighbours (large star) or the smaller ones and the node itself (small star)."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    # least of a node's neighbourhood, combined before the shuffle
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    tied = both.join(least, "u")
    if large:
        moved = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = tied.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its
    component. ``edges`` has two columns, u and v, of one ordered type.

    Alternating large and small stars; a logarithmic number of rounds, each of them
    written to the checkpoint folder. Only a count and a checksum reach the driver.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut(edges.filter("u <> v").select(high, low).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        if state[0] == 0:
            break
        now = cut(_starred(_starred(now, large=True), large=False))
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))

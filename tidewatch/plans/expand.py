"""Generating many rows from one without a large array in any row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 4096


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per integer from ``first`` to ``last``; none where last < first.

    Blocks are generated first and the numbers within a block next.
    """
    spans = df.withColumns({"__first": first.cast("long"), "__last": last.cast("long")}).filter(F.col("__first") <= F.col("__last"))
    blocks = spans.withColumn("__block", F.explode(F.sequence("__first", "__last", F.lit(_BLOCK).cast("long"))))
    end = F.least(F.col("__block") + _BLOCK - 1, F.col("__last"))
    return blocks.select(*df.columns, F.explode(F.sequence("__block", end)).alias(name))

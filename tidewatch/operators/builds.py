"""Image builds: cache usage and progress records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import required_value


def prune_report(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unused cache records and their bytes."""
    unused = usage.filter(~F.col("in_use"))
    return unused.groupBy(*(by or [])).agg(
        F.count("*").alias("n_records"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def build_progress(responses: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertex, status and log tables, one row per element of the responses."""
    carried = keep or []
    return tuple(responses.select(*carried, F.inline(name)) for name in ("vertexes", "statuses", "logs"))


def vertex_summary(vertexes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cached and failed counts and total seconds per vertex."""
    keys = by or ["digest"]
    seconds = (F.unix_micros("completed") - F.unix_micros("started")) / 1_000_000
    return vertexes.groupBy(*keys).agg(
        F.count("*").alias("n_updates"),
        F.count_if(F.col("cached")).alias("n_cached"),
        F.count_if(required_value(F.col("error")).isNotNull()).alias("n_failed"),
        F.sum(seconds).alias("seconds"),
    )

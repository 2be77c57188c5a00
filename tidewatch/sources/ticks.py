"""Ticker channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.expand import explode_range


def ticker_events(spans: DataFrame, period_seconds: int, start: str = "start", end: str = "end") -> DataFrame:
    """Ticks of each span: one per period, the first one period after the start,
    the last not after the end. Adds ``tick_no`` (from 1) and ``tick``.
    """
    if period_seconds <= 0:
        raise ValueError("a ticker needs a period")
    step = period_seconds * 1_000_000
    n_ticks = F.floor((F.unix_micros(end) - F.unix_micros(start)) / step)
    ticks = explode_range(spans, F.lit(1), n_ticks, "tick_no")
    return ticks.withColumn("tick", F.timestamp_micros(F.unix_micros(start) + F.col("tick_no") * step))


def stream_ticks(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """An endless stream of ticks."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select((F.col("value") + 1).alias("tick_no"), F.col("timestamp").alias("tick"))

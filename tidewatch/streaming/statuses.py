"""Statuses of finished runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.outcomes import status_lifecycle
from tidewatch.sources.sinks import write_statuses


def stream_statuses(finished: DataFrame, path: str, checkpoint: str, stream: str = "main") -> DataStreamWriter:
    """Write both statuses of every finished run to a table, each micro-batch
    once; ``latest_status`` reads it. ``stream`` tells streams into one table apart."""

    def step(batch: DataFrame, batch_id: int) -> None:
        write_statuses(batch, path, batch_id, stream)

    return status_lifecycle(finished).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

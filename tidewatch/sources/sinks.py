"""Sinks: statuses and logs. Each works on a batch or, as the function of
``foreachBatch``, on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.checks import LOG_OUTPUTS

LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _target(path: str, batch_id: int | None, stream: str) -> tuple[str, str]:
    """Folder and mode: a micro-batch has a folder of its own below its stream's,
    which a repetition overwrites; batches are appended beside the streams."""
    if batch_id is None:
        return f"{path}/stream=batch/batch_id=-1", "append"
    return f"{path}/stream={stream}/batch_id={batch_id}", "overwrite"


def write_statuses(statuses: DataFrame, path: str, batch_id: int | None = None, stream: str = "main") -> None:
    """Add statuses to a parquet table. Streams that write to one table need
    different names, and a stream with a new checkpoint a new name."""
    folder, mode = _target(path, batch_id, stream)
    statuses.write.mode(mode).parquet(folder)


def write_logs(entries: DataFrame, outputs: dict[str, str | None], batch_id: int | None = None, stream: str = "main") -> None:
    """Send every entry to every output. Both are folders that the tasks write to:
    ``stackdriver`` JSON entries, ``stdout`` lines of text (time, severity,
    payload, labels). A stdout without a folder would have to pass all entries
    through the driver and is refused."""
    unknown = [o for o in outputs if o not in LOG_OUTPUTS]
    if unknown:
        raise ValueError(f"unsupported outputs {unknown}, supported are {LOG_OUTPUTS}")
    missing = [o for o, target in outputs.items() if not target]
    if missing:
        raise ValueError(f"outputs {missing} need a folder")
    for kind, target in outputs.items():
        folder, mode = _target(target, batch_id, stream)
        if kind == "stdout":
            entries.select(log_line(entries).alias("value")).write.mode(mode).text(folder, lineSep="\n")
        else:
            entries.write.option("timestampFormat", LOG_TIME).mode(mode).json(folder)


def log_line(entries: DataFrame):
    """One line per entry: the entry as JSON, in which line breaks are escaped."""
    return F.to_json(F.struct(*entries.columns), {"timestampFormat": LOG_TIME})


def for_each_event(action: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """An action per micro-batch for ``foreachBatch``; empty batches are skipped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            action(batch.withColumn("batch_id", F.lit(batch_id)), batch_id)

    return run


"""Load shedding as a stream: counts per key and window carried between micro-batches.

Everything runs on whole micro-batches. What is carried is one count per key and
window, until ``lateness`` has passed since the window began to be the newest;
events that come for a window no longer carried are kept apart as late, so every
event is admitted, dropped or late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.routing import CHANNEL_CAP
from tidewatch.plans.ordered import first_in_group, join_same
from tidewatch.streaming.jobs import folders, is_complete, remove_folder

FOLDERS = ("admitted", "dropped", "late")
#: Folders of counts that are merged into one of the next level.
MERGED = 8


def _binned(events: DataFrame, ts: str, window: str) -> tuple[DataFrame, DataFrame]:
    """Events with their window, and those without a time."""
    untimed = events.filter(F.col(ts).isNull()).withColumn("window_start", F.lit(None).cast("timestamp"))
    return events.filter(F.col(ts).isNotNull()).withColumn("window_start", F.window(ts, window)["start"]), untimed


def stream_admit(
    events: DataFrame, keys: list[str], window: str, order: list[str], state: str, cap: int = CHANNEL_CAP, *, lateness: str = "7 days"
) -> DataStreamWriter:
    """Write the first ``cap`` events of each key and window, with their
    ``position`` of arrival, to ``state/admitted``, the others to ``state/dropped``
    and ``state/late``, in a folder per micro-batch. Within a micro-batch events
    count in the given total ``order``."""
    group = [*keys, "window_start"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_complete(spark, f"{state}/counts/batch={batch_id}"):
            return
        before = f"{state}/counts/batch={batch_id - 1}"
        known = spark.read.parquet(before) if is_complete(spark, before) else None
        binned, untimed = _binned(batch, order[0], window)
        timely, late = binned, binned.limit(0)
        if known is not None:
            horizon = F.lit(known.agg(F.max("window_start")).first()[0]) - F.expr(f"INTERVAL {lateness}")
            is_late = F.coalesce(F.col("window_start") < horizon, F.lit(False))
            timely, late = binned.filter(~is_late), binned.filter(is_late)
        ranked = first_in_group(timely, group, order, cap).withColumn("position", F.col("position").cast("long"))
        if known is not None:
            ranked = join_same(ranked, known.withColumnRenamed("n", "__n"), group, "left")
            ranked = ranked.withColumn("position", F.col("position") + F.coalesce("__n", F.lit(0))).drop("__n")
        taken = ranked.filter(F.col("position") <= cap)
        last = taken.groupBy(*group).agg(F.max(F.struct(*order)).alias("__last"))
        beyond = join_same(timely, last, group, "left").filter(F.col("__last").isNull() | (F.struct(*order) > F.col("__last"))).drop("__last")
        for folder, rows in zip(FOLDERS, (taken, beyond.unionByName(untimed), late), strict=True):
            rows.write.mode("overwrite").parquet(f"{state}/{folder}/batch={batch_id}")
        counts = timely.groupBy(*group).agg(F.count("*").alias("n"))
        if known is not None:
            counts = known.unionByName(counts).groupBy(*group).agg(F.sum("n").alias("n"))
        newest = counts.agg(F.max("window_start")).first()[0]
        if newest is not None:
            counts = counts.filter(F.col("window_start") >= F.lit(newest) - F.expr(f"INTERVAL {lateness}"))
        counts.write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")
        remove_folder(spark, f"{state}/counts/batch={batch_id - 2}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint")


def stream_admission_counts(
    events: DataFrame, keys: list[str], window: str, ts: str, state: str, *, width: int = MERGED
) -> DataStreamWriter:
    """Write the number of events per key and window of every micro-batch below
    ``state/counts``; ``admission_totals`` adds them up (``read_counts``). Nothing waits for a
    window to close, so open windows and late events are in it.

    The folders of ``width`` micro-batches are merged into one of the next level, those of
    ``width`` such into one of the level above, and so on: after n micro-batches there
    are fewer than ``width`` folders on each of log n levels, each row merged log n times.
    A folder goes only when the one that holds its counts is complete.
    """
    group, counts = [*keys, "window_start"], f"{state}/counts"

    def step(batch: DataFrame, batch_id: int) -> None:
        binned, _ = _binned(batch, ts, window)
        counted = binned.groupBy(*group).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(_counts_folder(counts, 0, batch_id))
        _merge(batch.sparkSession, counts, group, batch_id, width)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint")


def _counts_folder(counts: str, level: int, first: int) -> str:
    return f"{counts}/level={level}/batch={first}"


def _merge(spark: SparkSession, counts: str, group: list[str], batch_id: int, width: int) -> None:
    """Merge the folders of every level that ``batch_id`` fills."""
    level, size = 0, 1
    while (batch_id + 1) % (size * width) == 0:
        first = batch_id + 1 - size * width
        parts = [_counts_folder(counts, level, first + i * size) for i in range(width)]
        merged = _counts_folder(counts, level + 1, first)
        there = [] if is_complete(spark, merged) else [part for part in parts if is_complete(spark, part)]
        if there:
            rows = spark.read.parquet(*there).groupBy(*group).agg(F.sum("n").alias("n"))
            rows.write.mode("overwrite").parquet(merged)
        for part in parts:
            remove_folder(spark, part)
        level, size = level + 1, size * width


def read_counts(spark: SparkSession, state: str, *, width: int = MERGED) -> DataFrame:
    """The counts of a stream as it stands, also where it broke off between writing a
    merged folder and removing what it was made of."""
    complete: dict[tuple[int, int], str] = {}
    for folder in folders(spark, f"{state}/counts/level=*/batch=*"):
        level, first = (int(part.rsplit("=", 1)[1]) for part in folder.rstrip("/").rsplit("/", 2)[1:])
        if is_complete(spark, folder):
            complete[level, first] = folder
    top = max((level for level, _ in complete), default=0)

    def is_merged(level: int, first: int) -> bool:
        return any((above, first // width**above * width**above) in complete for above in range(level + 1, top + 1))

    return spark.read.parquet(*[folder for at, folder in sorted(complete.items()) if not is_merged(*at)])


def admission_totals(counts: DataFrame, keys: list[str], cap: int = CHANNEL_CAP) -> DataFrame:
    """Admitted and dropped events per key and window so far."""
    total = counts.groupBy(*keys, "window_start").agg(F.sum("n").alias("n"))
    return total.select(
        *keys, "window_start", F.least("n", F.lit(cap)).alias("n_admitted"), F.greatest(F.col("n") - cap, F.lit(0)).alias("n_dropped")
    )

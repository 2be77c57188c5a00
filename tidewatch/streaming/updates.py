"""Watching repositories as a stream.

A micro-batch of polls goes through the batch operator, together with what the
batches before it left: a mark per watch, and the remembered version of each entity
that was polled within ``forget`` of the newest poll. Both are small tables, written
per batch beside its updates; the tables of older batches are removed. A batch that is
run again after a crash overwrites what was left half written.

A poll's rows must arrive in one micro-batch, and polls in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import changes
from tidewatch.streaming.jobs import is_complete, remove_folder, run_once

FORGET = "90 days"


def _read_if_complete(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.parquet(folder) if is_complete(spark, folder) else None


def _new_marks(seen: DataFrame, known: DataFrame | None) -> DataFrame:
    raised = seen.filter(~F.col("silent")).groupBy("watch").agg(F.max("last_updated").alias("mark"))
    return raised if known is None else known.unionByName(raised).groupBy("watch").agg(F.max("mark").alias("mark"))


def _new_versions(seen: DataFrame, version: Column, keys: list[str], known: DataFrame | None, forget: str) -> DataFrame:
    entity = ["watch", *keys]
    latest = seen.select(*entity, "poll_ts", version.alias("version"))
    every = latest if known is None else known.unionByName(latest)
    newest = every.groupBy(*entity).agg(F.max_by("version", "poll_ts").alias("version"), F.max("poll_ts").alias("poll_ts"))
    end = every.agg(F.max("poll_ts")).first()[0]
    return newest if end is None else newest.filter(F.col("poll_ts") >= F.lit(end) - F.expr(f"INTERVAL {forget}"))


def _step(watched: Callable[[DataFrame], DataFrame], keys: list[str], version: Column, news: dict[str, Column], start: Column, state: str, forget: str):
    """``foreachBatch`` step: ``updates``, ``versions`` and, last, ``marks`` in a
    folder per batch below ``state``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_complete(spark, f"{state}/marks/batch={batch_id}"):
            return
        marks = _read_if_complete(spark, f"{state}/marks/batch={batch_id - 1}")
        versions = _read_if_complete(spark, f"{state}/versions/batch={batch_id - 1}")
        seen = changes.watch_polls(watched(batch), keys, version, news, start, marks=marks, versions=versions)
        updates = seen.filter(~F.col("silent")).drop("silent", "__prev")
        updates.write.mode("overwrite").parquet(f"{state}/updates/batch={batch_id}")
        _new_versions(seen, version, keys, versions, forget).write.mode("overwrite").parquet(f"{state}/versions/batch={batch_id}")
        _new_marks(seen, marks).write.mode("overwrite").parquet(f"{state}/marks/batch={batch_id}")
        # a restart goes on from the last batch or repeats it, which needs the one before
        for name in ("marks", "versions"):
            remove_folder(spark, f"{state}/{name}/batch={batch_id - 2}")

    return step


def _updates_once(polls: DataFrame, step, state: str, nothing: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = polls.sparkSession
    run_once(polls.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint"))
    empty = nothing(spark.createDataFrame([], polls.schema))
    if not is_complete(spark, f"{state}/updates/batch=0"):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{state}/updates").select(*empty.columns)


def stream_pr_updates(polls: DataFrame, rules: DataFrame, start: Column, state: str, *, forget: str = FORGET) -> DataFrame:
    """Run the stream of polls over all that is there and return all updates
    found so far. ``state`` is a shared folder; calling again goes on from it."""
    step = _step(
        lambda batch: changes.watched_pull_requests(batch, rules),
        ["repo", "number"], changes.pull_request_version(), changes.pull_request_news(), start, state, forget,
    )
    return _updates_once(polls, step, state, lambda none: changes.pull_request_updates(none, rules, start))


def stream_branch_updates(polls: DataFrame, start: Column, state: str, rules: DataFrame | None = None, *, forget: str = FORGET) -> DataFrame:
    """As ``stream_pr_updates``, for branches."""
    step = _step(
        lambda batch: changes.watched_branches(batch, rules), ["repo", "name"], F.struct("oid"), changes.branch_news(), start, state, forget
    )
    return _updates_once(polls, step, state, lambda none: changes.branch_updates(none, start, rules))

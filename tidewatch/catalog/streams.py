"""Streaming twins run over the whole tables; each has the SQL of its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import chatting, running, shaping, watching
from tidewatch.catalog.registry import ORACLES, query, table
from tidewatch.operators import logs, outcomes, routing
from tidewatch.session import shared_folder
from tidewatch.sources.sinks import LOG_TIME, write_logs
from tidewatch.streaming.admission import admission_totals, read_counts, stream_admission_counts, stream_admit
from tidewatch.streaming.conversations import stream_conversations
from tidewatch.streaming.jobs import run_once, stream_table
from tidewatch.streaming.statuses import stream_statuses
from tidewatch.streaming.updates import stream_branch_updates, stream_pr_updates


BATCHES = 5


def fed(spark: SparkSession, df: DataFrame, ts: str, name: str, run: Callable[[DataFrame], object]) -> object:
    """Feed a table to a stream in ``BATCHES`` stretches of time, the earliest first.
    After each, ``run`` takes up the stream where it stopped; the last result counts."""
    folder = shared_folder(spark, name)
    df.write.parquet(f"{folder}/all")
    every = spark.read.schema(df.schema).parquet(f"{folder}/all")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = every.agg(F.min(at), F.max(at)).first()
    width = ((last or 0) - (first or 0)) // BATCHES + 1
    stretch = F.floor((at - (first or 0)) / width)
    result = None
    for number in range(BATCHES):
        every.filter(stretch == number).write.mode("append").parquet(f"{folder}/input")
        result = run(stream_table(spark, f"{folder}/input", df.schema))
    return result


@query("stream_pull_request_updates", ORACLES["watch_pull_request_updates"])
def pr_updates(spark, sf):
    state, ruled = shared_folder(spark, "pr-updates"), watching.rules(spark, sf)
    run = lambda polls: stream_pr_updates(polls, ruled, watching.start(), state)
    return watching.shown_updates(fed(spark, watching.polls(spark, sf), "poll_ts", "polls", run))


@query("stream_branch_updates", ORACLES["watch_branch_updates"])
def branch_updates(spark, sf):
    state, ruled = shared_folder(spark, "branch-updates"), watching.rules(spark, sf)
    run = lambda heads: stream_branch_updates(heads, F.lit("1995-06-01").cast("timestamp"), state, ruled)
    return watching.shown_branches(fed(spark, watching.heads(spark, sf), "poll_ts", "heads", run))


@query("stream_conversations", ORACLES["chat_conversations"])
def conversations(spark, sf):
    state = shared_folder(spark, "conversations")

    def run(events: DataFrame) -> DataFrame:
        return stream_conversations(
            chatting.as_talk(events), chatting.TALK, state, thread=["thread"], order=["ts", "event_id"], self_id="BOT", forget="10 years"
        )

    return fed(spark, table(spark, sf, "events"), "ts", "talk", run).select("thread", "event_id", "phase", "reply", "is_event")


@query("stream_admit", ORACLES["route_admit"])
def admit(spark, sf):
    state = shared_folder(spark, "admit")
    run = lambda events: run_once(stream_admit(events, ["event_type"], "1 day", ["ts", "event_id"], state, routing.PROCESS_CAP))
    fed(spark, table(spark, sf, "events"), "ts", "events", run)
    return spark.read.parquet(f"{state}/admitted").select(
        "event_id", "event_type", F.unix_micros("window_start").alias("window_us"), F.col("position").cast("int").alias("position")
    )


@query("stream_admission_counts", ORACLES["route_admission_counts"])
def admission(spark, sf):
    state = shared_folder(spark, "admission")
    run = lambda events: run_once(stream_admission_counts(events, ["event_type"], "1 day", "ts", state))
    fed(spark, table(spark, sf, "events"), "ts", "events", run)
    counts = admission_totals(read_counts(spark, state), ["event_type"], routing.PROCESS_CAP)
    return counts.select("event_type", F.unix_micros("window_start").alias("window_us"), "n_admitted", "n_dropped")


@query("stream_statuses", ORACLES["outcome_latest_status"])
def statuses(spark, sf):
    folder = shared_folder(spark, "statuses")
    run = lambda orders: run_once(stream_statuses(running.as_finished(orders), f"{folder}/table", f"{folder}/checkpoint"))
    fed(spark, table(spark, sf, "orders"), "o_orderdate", "orders", run)
    kept = spark.read.parquet(f"{folder}/table").drop("batch_id", "stream").withColumn("tie", F.struct("run_id", "status_no"))
    return outcomes.latest_status(kept, tie="tie", base="").drop("ts")


@query("sink_logs", f"SELECT unnest(['stackdriver', 'stdout']) AS output, e.* FROM ({ORACLES['log_entries']}) e")
def log_sink(spark, sf):
    entries = logs.to_log_entries(logs.enrich_logs(shaping.entries(spark, sf), shaping.log_runs(spark, sf)))
    folder = shared_folder(spark, "logs")
    write_logs(entries, {"stackdriver": f"{folder}/entries", "stdout": f"{folder}/lines"})
    lines = spark.read.text(f"{folder}/lines").select(F.from_json("value", entries.schema, {"timestampFormat": LOG_TIME}).alias("e")).select("e.*")
    # an entry comes back twice, once from each output, or the counts differ
    both = spark.read.schema(entries.schema).json(f"{folder}/entries").drop("stream", "batch_id").withColumn("output", F.lit("stackdriver"))
    kept = both.unionByName(lines.withColumn("output", F.lit("stdout")))
    return kept.select("output", F.unix_micros("ts").alias("ts_us"), "severity", shaping.flat("labels").alias("labels"), "payload")

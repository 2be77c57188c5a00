"""Fan-in, fan-out, load shedding, exits, runs and live versions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import required_value, short_id
from tidewatch.plans.expand import explode_range
from tidewatch.plans.ordered import (
    HOT_ROWS, bounded_broadcast, first_in_group, heavy_keys, join_same, running_sum, small_enough, with_previous, with_running,
)
from tidewatch.session import cut

# Queue sizes, events per channel and per process.
CHANNEL_CAP = 1024
PROCESS_CAP = 32


def fan_in(*inputs: DataFrame) -> DataFrame:
    """All events of all inputs; columns an input lacks are NULL."""
    if not inputs:
        raise ValueError("fan_in needs at least one input")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def duplicate(df: DataFrame, n: int | Column) -> DataFrame:
    """Each event ``n`` times, numbered ``copy`` from 1."""
    return explode_range(df, F.lit(1), F.lit(n) if isinstance(n, int) else n, "copy")


def broadcast_events(events: DataFrame, processes: DataFrame, *, limit: int = HOT_ROWS) -> DataFrame:
    """Every event with every process of its group. Few processes are sent to the events.
    Among many, those of a group with more than ``limit`` events are sent, so that no task
    gets all events of one."""
    listed = processes.select("group_id", F.col("name").alias("process"))
    if small_enough(listed):
        return events.join(F.broadcast(listed), "group_id")
    hot = heavy_keys(events.filter(F.col("group_id").isNotNull()), ["group_id"], limit).select("group_id")
    n_hot = hot.count()
    if n_hot == 0:
        return events.join(listed, "group_id")
    hot = bounded_broadcast(hot, n_hot)
    of_hot = listed.join(hot, "group_id", "left_semi")
    apart = events.join(hot, "group_id", "left_semi").join(bounded_broadcast(of_hot, of_hot.count()), "group_id")
    return apart.unionByName(events.join(hot, "group_id", "left_anti").join(listed, "group_id"))


#: Parts of a window that are counted to find where its cap is reached.
SLOTS = 1024


def admit(
    events: DataFrame, keys: list[str], window: str, order: list[str], cap: int = CHANNEL_CAP, *, limit: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Load shedding: (admitted, dropped).

    Each key takes the first ``cap`` events of a window (``window`` is a
    duration such as ``1 hour`` over ``order[0]``); the newest beyond are dropped,
    and so are events without a time, which belong to no window. A null key is a
    key like any other.

    Events are counted per slot of their window first, from keys and times alone. The
    running sum says in which slot the cap is reached, so later events are dropped
    and earlier ones admitted by their slot. Only what reaches the cap is ranked: at most
    ``cap`` events and one slot of each window, never all events of a hot key.
    """
    ts = order[0]
    untimed = events.filter(F.col(ts).isNull()).withColumn("window_start", F.lit(None).cast("timestamp"))
    at = F.window(ts, window)
    begin, end = F.unix_micros(at["start"]), F.unix_micros(at["end"])
    slot = F.floor((F.unix_micros(ts) - begin) / ((end - begin) / F.lit(SLOTS)))
    binned = events.filter(F.col(ts).isNotNull()).withColumns({"window_start": at["start"], "__slot": slot})
    group = [*keys, "window_start"]
    counted = binned.groupBy(*group, "__slot").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__slot"))
    reached = counted.withColumn("__upto", upto).filter((F.col("__upto") >= cap) & (F.col("__upto") - F.col("__n") < cap))
    edges = cut(reached.select(*group, F.col("__slot").alias("__edge"), "__upto"))
    n_edges, most = edges.agg(F.count("*"), F.max("__upto")).first()
    marked = join_same(binned, bounded_broadcast(edges.drop("__upto"), n_edges), group, "left")
    near = marked.filter(F.col("__edge").isNull() | (F.col("__slot") <= F.col("__edge"))).drop("__slot", "__edge")
    if (most or 0) <= limit:
        position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        admitted = near.withColumn("position", position).filter(F.col("position") <= cap)
    else:  # so many events in one slot that they are ranked as a tree
        admitted = first_in_group(near, group, order, cap)
    full = admitted.filter(F.col("position") == cap).select(*group, F.struct(*order).alias("__last"))
    at_edge = join_same(marked.filter(F.col("__slot") == F.col("__edge")), full, group).filter(F.struct(*order) > F.col("__last"))
    beyond = marked.filter(F.col("__slot") > F.col("__edge")).unionByName(at_edge.drop("__last")).drop("__slot", "__edge")
    return admitted, beyond.unionByName(untimed)


def admission_counts(events: DataFrame, keys: list[str], window: str, ts: str, cap: int = CHANNEL_CAP) -> DataFrame:
    """Admitted and dropped events per key and window."""
    counted = events.groupBy(*keys, F.window(ts, window).alias("__w")).agg(F.count("*").alias("__n"))
    return counted.select(
        *keys,
        F.col("__w.start").alias("window_start"),
        F.least("__n", F.lit(cap)).alias("n_admitted"),
        F.greatest(F.col("__n") - cap, F.lit(0)).alias("n_dropped"),
    )


def until_exit(events: DataFrame, group: list[str], order: list[str], is_exit: str = "is_exit") -> DataFrame:
    """Events of each group up to and including its first exit event.

    Only the position of the first exit is aggregated, so a group may have any
    size. A null group is a group like any other.
    """
    exits = events.filter(F.col(is_exit)).groupBy(*group).agg(F.min(F.struct(*order)).alias("__exit"))
    joined = join_same(events, exits, group, "left")
    return joined.filter(F.col("__exit").isNull() | (F.struct(*order) <= F.col("__exit"))).drop("__exit")


def runs(deliveries: DataFrame, is_exit: str = "is_exit") -> DataFrame:
    """One run per delivered event that is not an exit."""
    live = deliveries.filter(~F.coalesce(is_exit, F.lit(False)))
    return live.select(
        short_id(F.col("event_id"), F.col("process")).alias("run_id"),
        "process",
        "event_id",
        F.col("created_at").alias("started_at"),
    )


def live_versions(loads: DataFrame, *, limit: int = HOT_ROWS) -> DataFrame:
    """Lifetime of each loaded version (name, version, started_at, finished_at).

    A reload stops the older version (``valid_to``); an older version that
    finishes never removes a newer one, so ``is_current`` is the last load of a
    name unless that very version has finished.
    """
    following = with_previous(loads, ["name"], ["started_at", "version"], {"__next": "started_at"}, reverse=True, limit=limit)
    return following.select(
        *loads.columns,
        F.least("__next", "finished_at").alias("valid_to"),
        (F.col("is_first") & F.col("finished_at").isNull()).alias("is_current"),
    )


def run_durations(finished: DataFrame) -> DataFrame:
    """Seconds per process and outcome."""
    elapsed = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000
    return (
        finished.withColumns({"__s": elapsed, "ok": F.coalesce("error", F.lit("")) == ""})
        .groupBy("process", "ok")
        .agg(
            F.count("*").alias("n_runs"),
            F.avg("__s").alias("avg_seconds"),
            F.max("__s").alias("max_seconds"),
            F.percentile_approx("__s", 0.5).alias("median_seconds"),
        )
    )


#: Size of a quantile sketch, and the share of runs by which the rank of what it gives may
#: be off (five of its standard errors, 2.3 / SKETCH ** 0.9).
SKETCH, SKETCH_ERROR = 1024, 0.0225


def duration_sketches(finished: DataFrame) -> DataFrame:
    """Runs per day, process and outcome: count, sum, maximum and a quantile sketch of the
    seconds. Written once a day, such rows never change and can be added up."""
    elapsed = F.unix_micros("ended_at") - F.unix_micros("started_at")
    return (
        finished.withColumns({"__us": elapsed, "ok": F.coalesce("error", F.lit("")) == ""})
        .groupBy(F.to_date("ended_at").alias("day"), "process", "ok")
        .agg(
            F.count("*").alias("n_runs"), F.sum("__us").alias("sum_us"), F.max("__us").alias("max_us"),
            F.kll_sketch_agg_bigint("__us", F.lit(SKETCH)).alias("sketch"),
        )
    )


def merged_durations(sketches: DataFrame, share: float = 0.5) -> DataFrame:
    """Seconds per process and outcome over any days of ``duration_sketches``: exact but for
    the quantile, whose rank is off by at most ``SKETCH_ERROR``."""
    merged = sketches.groupBy("process", "ok").agg(
        F.sum("n_runs").alias("n_runs"), F.sum("sum_us").alias("__sum"), F.max("max_us").alias("__max"),
        F.kll_merge_agg_bigint("sketch").alias("__sketch"),
    )
    return merged.select(
        "process", "ok", "n_runs",
        (F.col("__sum") / F.col("n_runs") / 1_000_000).alias("avg_seconds"),
        (F.col("__max") / 1_000_000).alias("max_seconds"),
        (F.kll_sketch_get_quantile_bigint("__sketch", F.lit(share)) / 1_000_000).alias("quantile_seconds"),
    )


def process_defaults(specs: DataFrame, host: str, order: list[str]) -> DataFrame:
    """Names for unnamed processes (``host-1``, ``host-2``, ... in ``order``),
    the oneshot channel where none is watched, and ``error`` without a run."""
    unnamed = required_value(F.col("name")).isNull()
    numbered = with_running(specs, [], order, {"__n": running_sum(unnamed.cast("long"))})
    made_up = F.concat(F.lit(f"{host}-"), (F.col("__n") + 1).cast("string"))
    return numbered.withColumns(
        {
            "name": F.when(required_value(F.col("name")).isNull(), made_up).otherwise(F.col("name")),
            "watch": F.coalesce(required_value(F.col("watch")), F.lit("oneshot")),
            "error": F.when(required_value(F.col("run")).isNull(), "the process needs a run parameter"),
        }
    ).drop("__n")

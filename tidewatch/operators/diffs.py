"""Differences between two snapshots, and upserts of desired objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import go_duration, go_quoted, required_value
from tidewatch.plans.ordered import join_same

SUPPORTED_KINDS = ["Job", "Deployment", "Service"]


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` that are absent in ``old`` (ADDED) or differ (CHANGED).

    Rows only in ``old`` are not reported. ``compare`` limits which columns
    count; only those are read from ``old``. Old values come as ``old_<name>``.
    """
    compared = compare or [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*compared).alias("__old"))
    joined = join_same(new, before, keys, "left")
    change = F.when(F.col("__old").isNull(), "ADDED").when(~F.col("__old").eqNullSafe(F.struct(*compared)), "CHANGED")
    return (
        joined.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*new.columns, "change", *[F.col(f"__old.{c}").alias(f"old_{c}") for c in compared])
    )


def _same_state(a: Column, b: Column) -> Column:
    """Both running, both terminated or both waiting; two unknown states differ."""
    known = F.lower(a).isin("running", "terminated", "waiting")
    return F.coalesce(known & (F.lower(a) == F.lower(b)), F.lit(False))


def _container_changes(old: Column, new: Column) -> Column:
    """Array of changed containers of one pod, each with its old and new status."""
    def before(c: Column) -> Column:
        return F.get(F.filter(old, lambda o: o["name"] == c["name"]), F.lit(0))

    paired = F.transform(new, lambda c: F.struct(c["name"].alias("name"), before(c).alias("old"), c.alias("new")))
    return F.filter(
        paired,
        lambda p: p["old"].isNull()
        | ~_same_state(p["old"]["state"], p["new"]["state"])
        | ~p["old"]["restarts"].eqNullSafe(p["new"]["restarts"]),
    )


def pod_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pods that are new, changed phase or have changed containers.

    One join on (namespace, name); containers are compared inside the row.
    """
    keys = ["namespace", "name"]
    before = old.select(*keys, F.struct(F.col("phase"), F.col("containers")).alias("__old"))
    joined = join_same(new, before, keys, "left").withColumn(
        "container_changes", _container_changes(F.col("__old.containers"), F.col("containers"))
    )
    added = F.col("__old").isNull()
    phase_changed = ~added & ~F.col("__old.phase").eqNullSafe(F.col("phase"))
    return joined.filter(added | phase_changed | (F.size("container_changes") > 0)).select(
        *keys,
        added.alias("is_added"),
        F.when(phase_changed, F.struct(F.col("__old.phase").alias("old"), F.col("phase").alias("new"))).alias("phase_change"),
        "container_changes",
    )


def container_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per changed container: name, its old and new status."""
    return pod_diff(old, new).select("namespace", F.col("name").alias("pod"), "is_added", F.inline("container_changes"))


def describe_state(status: Column, now: Column) -> Column:
    micros = F.unix_micros
    ran = micros(status["finished_at"]) - micros(status["started_at"])
    return (
        F.when(F.lower(status["state"]) == "running", F.concat(F.lit("running for "), go_duration(micros(now) - micros(status["started_at"]))))
        .when(
            F.lower(status["state"]) == "terminated",
            F.concat(
                F.lit("terminated with exit code "),
                status["exit_code"].cast("string"),
                F.lit(" after running for "),
                go_duration(ran),
                F.lit(", reason: "),
                F.coalesce(status["reason"], F.lit("")),
            ),
        )
        .when(F.lower(status["state"]) == "waiting", "waiting to start")
        .otherwise("<unknown>")
    )


def describe_changes(diffs: DataFrame, now: Column) -> DataFrame:
    """One line of text per change of a pod, numbered in reading order."""
    pod = F.concat(F.lit("Pod "), F.col("name"), F.lit(" in namespace "), F.col("namespace"))
    created = F.when(F.col("is_added"), F.concat(F.lit("Created "), pod, F.lit(".")))
    phase = F.when(
        F.col("phase_change").isNotNull(),
        F.concat(
            pod,
            F.lit(", has changed state from "),
            go_quoted(F.col("phase_change.old")),
            F.lit(" to "),
            go_quoted(F.col("phase_change.new")),
            F.lit("."),
        ),
    )

    def container(c: Column) -> Column:
        new_state = go_quoted(describe_state(c["new"], now))
        return (
            F.when(c["old"].isNull(), F.concat(F.lit("Container "), c["name"], F.lit(" created, current state is "), new_state, F.lit(".")))
            .when(
                ~c["old"]["restarts"].eqNullSafe(c["new"]["restarts"]),
                F.concat(F.lit("Container "), go_quoted(c["name"]), F.lit(" restarted, current state is "), new_state, F.lit(".")),
            )
            .otherwise(
                F.concat(
                    F.lit("Container "),
                    go_quoted(c["name"]),
                    F.lit(" changed status from "),
                    go_quoted(describe_state(c["old"], now)),
                    F.lit(" to "),
                    new_state,
                    F.lit("."),
                )
            )
        )

    containers = F.transform(F.array_sort("container_changes"), container)
    lines = F.array_compact(F.concat(F.array(created, phase), containers))
    return diffs.select("namespace", "name", F.posexplode(lines).alias("line_no", "text"))


def log_streams_to_open(changes: DataFrame, first_check: bool) -> DataFrame:
    """Changed containers whose logs to read: running ones, and on the first
    check those already terminated."""
    state = F.lower("new.state")
    wanted = (state == "running") | (F.lit(first_check) & (state == "terminated"))
    return changes.filter(wanted).select("namespace", "pod", "name")


def upsert_objects(
    current: DataFrame,
    desired: DataFrame,
    keys: list[str],
    keep: tuple[str, ...] = ("cluster_ip", "resource_version"),
    keep_kinds: tuple[str, ...] = ("Service",),
) -> DataFrame:
    """The table after applying ``desired``, with ``action`` CREATE, UPDATE or KEEP.

    Desired rows replace current ones, but rows of ``keep_kinds`` keep the
    ``keep`` columns of the current row. Nothing is deleted. ``kind`` must be one
    of the keys.
    """
    columns = [c for c in desired.columns if c not in keys]
    left = current.select(*keys, F.struct(*columns).alias("__cur"))
    right = desired.select(*keys, F.struct(*columns).alias("__new"))
    joined = join_same(left, right, keys, "full")
    has_cur, has_new = F.col("__cur").isNotNull(), F.col("__new").isNotNull()
    action = F.when(has_cur & has_new, "UPDATE").when(has_new, "CREATE").otherwise("KEEP")

    def value(name: str) -> Column:
        held = F.col("kind").isin(*keep_kinds) if name in keep else F.lit(False)
        return F.when(has_new & ~(has_cur & held), F.col(f"__new.{name}")).otherwise(F.col(f"__cur.{name}"))

    return joined.select(*keys, *[value(c).alias(c) for c in columns], action.alias("action"))


def unsupported_objects(desired: DataFrame) -> DataFrame:
    """Desired objects of a kind that cannot be applied."""
    kind = F.coalesce(required_value(F.col("kind")), F.lit("<none>"))
    return desired.filter(~kind.isin(*SUPPORTED_KINDS)).withColumn("error", F.concat(F.lit("object "), kind, F.lit(" is not supported")))

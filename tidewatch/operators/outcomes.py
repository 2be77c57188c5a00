"""From step logs to run outcomes, statuses and exit codes.

Everything here is a plain grouped aggregate (combined map-side) or a running
sum, so one run may hold any share of the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import required_value, status_context
from tidewatch.plans.ordered import HOT_ROWS, join_same, running_sum, with_running

# States of a commit status and texts of the two wrappers.
STATES = ["success", "pending", "failure", "error"]
SUCCESS_TEXT = "CI executed successfully"
STARTED_TEXT = ":shipit: Started action, check logs at "
FAILED_TEXT = ":collision: Action failed with "
COMPLETED_TEXT = ":heavy_check_mark: Action completed successfully."


def sequence_outcome(steps: DataFrame, run: list[str] | None = None, *, count_double: bool = False) -> DataFrame:
    """Outcome of each run over its ordered steps (seq_no, is_deferred, error, value).

    Steps run until the first error; deferred steps always run, last one first,
    and none stops another. ``value`` is that of the last plain step that ran.
    ``error`` is the last deferred error in running order, else the step error.
    ``first_error_seq`` tells which steps were skipped. ``count_double`` counts a
    deferred step placed before the failing step twice, as it is collected twice.
    """
    run = run or ["run_id"]
    failed = required_value(F.col("error")).isNotNull()
    plain = ~F.col("is_deferred")
    plain_error, deferred_error = plain & failed, F.col("is_deferred") & failed
    grouped = steps.groupBy(*run).agg(
        F.min(F.when(plain_error, F.col("seq_no"))).alias("first_error_seq"),
        F.min_by("error", F.when(plain_error, F.col("seq_no"))).alias("__step_error"),
        F.min_by("value", F.when(plain_error, F.col("seq_no"))).alias("__error_value"),
        F.max_by("value", F.when(plain, F.col("seq_no"))).alias("__last_value"),
        # deferred steps run in reverse, so the lowest one reports last
        F.min_by("error", F.when(deferred_error, F.col("seq_no"))).alias("__deferred_error"),
        F.count_if(F.col("is_deferred")).alias("n_deferred"),
        F.count_if(deferred_error).alias("n_deferred_failed"),
        F.count_if(plain).alias("n_plain"),
    )
    outcome = grouped.select(
        *run,
        F.when(F.col("first_error_seq").isNotNull(), F.col("__error_value")).otherwise(F.col("__last_value")).alias("value"),
        F.coalesce("__deferred_error", "__step_error").alias("error"),
        F.coalesce("__deferred_error", "__step_error").isNull().alias("ok"),
        "first_error_seq",
        "n_plain",
        F.col("n_deferred").alias("n_deferred_run"),
        "n_deferred_failed",
    )
    if not count_double:
        return outcome
    reached = step_states(steps, run).filter(F.col("is_deferred") & F.col("reached")).groupBy(*run).agg(F.count("*").alias("__again"))
    return (
        join_same(outcome, reached, run, "left")
        .withColumn("n_deferred_run", F.col("n_deferred_run") + F.coalesce("__again", F.lit(0)))
        .drop("__again")
    )


def step_states(steps: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Each step with ``state`` (ok, failed, skipped or deferred) and
    ``reached``: whether the run got to its place."""
    run = run or ["run_id"]
    failed = required_value(F.col("error")).isNotNull()
    first = (
        steps.filter(~F.col("is_deferred") & failed).groupBy(*run).agg(F.min("seq_no").alias("__first"))
    )
    reached = F.col("__first").isNull() | (F.col("seq_no") <= F.col("__first"))
    state = F.when(F.col("is_deferred"), "deferred").when(~reached, "skipped").when(failed, "failed").otherwise("ok")
    return join_same(steps, first, run, "left").select(*steps.columns, state.alias("state"), reached.alias("reached"))


def parallel_outcome(branches: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Outcome of runs whose branches (branch, error, value, ended_at) all ran:
    fails if any branch failed. The errors and values of all branches are the
    rows of ``parallel_slots``; ``first_error`` is the earliest one."""
    run = run or ["run_id"]
    failed = required_value(F.col("error")).isNotNull()
    return branches.groupBy(*run).agg(
        F.bool_and(~failed).alias("ok"),
        F.count("*").alias("n_branches"),
        F.count_if(failed).alias("n_failed"),
        F.min_by("error", F.when(failed, F.struct("ended_at", "branch"))).alias("first_error"),
    )


def parallel_slots(branches: DataFrame, run: list[str] | None = None, zero: Column | None = None, *, limit: int = HOT_ROWS) -> DataFrame:
    """One row per result slot: slots fill in order of arrival, and a failed
    branch leaves a zero value (empty text unless ``zero`` is given)."""
    run = run or ["run_id"]
    failed = required_value(F.col("error")).isNotNull()
    placed = with_running(branches, run, ["ended_at", "branch"], {"slot": running_sum(F.lit(1))}, limit=limit)
    return placed.withColumn("value", F.when(failed, F.lit("") if zero is None else zero).otherwise(F.col("value")))


def status_lifecycle(finished: DataFrame, context: str | None = None) -> DataFrame:
    """Two statuses per run: pending at its start, then success or failure."""
    failed = required_value(F.col("error")).isNotNull()
    label = F.col("process") if context is None else F.lit(context)

    def status(order: int, state: Column, text: Column, ts: str) -> Column:
        return F.struct(F.lit(order).alias("status_no"), state.alias("state"), text.alias("description"), F.col(ts).alias("ts"))

    pair = F.array(
        status(1, F.lit("pending"), F.lit(""), "started_at"),
        status(
            2,
            F.when(failed, "failure").otherwise("success"),
            F.when(failed, F.col("error")).otherwise(SUCCESS_TEXT),
            "ended_at",
        ),
    )
    return finished.select("run_id", "repo", "commit", label.alias("context"), F.inline(pair))


def chat_lifecycle(finished: DataFrame) -> DataFrame:
    """Messages around a run started from chat: started, failed with the error
    if it did, and completed. (A failed run also says completed.)"""
    failed = required_value(F.col("error")).isNotNull()
    url = F.coalesce("url", F.lit("")) if "url" in finished.columns else F.lit("")
    started = F.struct(F.lit(1).alias("message_no"), F.concat(F.lit(STARTED_TEXT), url, F.lit(".")).alias("text"))
    failure = F.struct(F.lit(2).alias("message_no"), F.concat(F.lit(FAILED_TEXT), "error", F.lit(".")).alias("text"))
    completed = F.struct(F.lit(3).alias("message_no"), F.lit(COMPLETED_TEXT).alias("text"))
    return finished.select("run_id", F.inline(F.array_compact(F.array(started, F.when(failed, failure), completed))))


def latest_status(statuses: DataFrame, tie: str | None = None, product: str = "CI", base: str | None = None) -> DataFrame:
    """Newest status per repo, commit and context, state in lower case and a
    description of its own where none is given. With ``base`` the contexts read
    ``base/context``."""
    labelled = statuses
    if base is not None:
        labelled = statuses.withColumn("context", status_context(F.lit(base), F.col("context")))
    newest = F.struct("ts", tie) if tie else F.col("ts")
    latest = labelled.groupBy("repo", "commit", "context").agg(F.max_by(F.struct("state", "description", "ts"), newest).alias("s"))
    text = F.concat(F.lit(f"{product} build "), "s.state")
    return latest.select(
        "repo",
        "commit",
        "context",
        F.lower("s.state").alias("state"),
        F.coalesce(required_value(F.col("s.description")), text).alias("description"),
        F.col("s.ts").alias("ts"),
    )


def exit_code(error: Column, process_code: Column) -> Column:
    """0 without an error, the process's own code if it exited, else -1."""
    return F.when(required_value(error).isNull(), 0).otherwise(F.coalesce(process_code, F.lit(-1)))


def group_exit_codes(exits: DataFrame, tie: str = "event_id") -> DataFrame:
    """Exit code of each group: that of the last exit event it received."""
    return exits.groupBy("group_id").agg(F.max_by("exit_code", F.struct("created_at", tie)).alias("exit_code"))


def fleet_outcome(hosts: DataFrame, commands: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host and per run: every host runs the command list in sequence, hosts
    side by side.

    ``hosts``: run_id, host. ``commands``: run_id, seq_no. ``results``: run_id,
    host, seq_no, error, value, ended_at. A run without hosts or commands fails.
    """
    steps = results.withColumn("is_deferred", F.lit(False))
    last = results.groupBy("run_id", "host").agg(F.max("ended_at").alias("ended_at"))
    known_hosts = hosts.select("run_id", "host").distinct()
    per_host = known_hosts.join(
        sequence_outcome(steps, ["run_id", "host"]).select("run_id", "host", "value", "error", "ok", "first_error_seq"),
        ["run_id", "host"],
        "left",
    ).join(last, ["run_id", "host"], "left")
    n_commands = commands.groupBy("run_id").agg(F.count("*").alias("n_commands"))
    n_hosts = per_host.groupBy("run_id").agg(
        F.count("*").alias("n_hosts"),
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("n_failed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("ended_at", "host"))).alias("__error"),
    )
    joined = n_hosts.join(n_commands, "run_id", "full")
    error = (
        F.when(F.coalesce("n_commands", F.lit(0)) == 0, "provide at least one session action")
        .when(F.coalesce("n_hosts", F.lit(0)) == 0, "a session needs at least one host")
        .otherwise(F.col("__error"))
    )
    per_run = joined.select(
        "run_id",
        F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"),
        F.coalesce("n_commands", F.lit(0)).alias("n_commands"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        error.alias("error"),
        error.isNull().alias("ok"),
    )
    return per_host, per_run


def error_rows(rows: DataFrame, run: list[str], order: list[str], *, limit: int = HOT_ROWS) -> DataFrame:
    """All errors of a run, one row each, numbered in order."""
    failed = rows.filter(required_value(F.col("error")).isNotNull())
    numbered = with_running(failed, run, order, {"__before": running_sum(F.lit(1))}, limit=limit)
    return numbered.select(*run, (F.col("__before") + 1).alias("error_no"), "error")


def error_summary(rows: DataFrame, run: list[str], order: list[str], *, part_size: int = 1000, limit: int = HOT_ROWS) -> DataFrame:
    """Errors of a run as text: one row per ``part_no`` (from 1) with up to
    ``part_size`` errors in order. All parts of a run joined with ``, `` are its
    whole message; no error is left out and no cell grows with the run."""
    numbered = error_rows(rows, run, order, limit=limit)
    part = (F.floor((F.col("error_no") - 1) / part_size) + 1).cast("long").alias("part_no")
    grouped = numbered.groupBy(*run, part).agg(F.count("*").alias("n_errors"), F.collect_list(F.struct("error_no", "error")).alias("__errors"))
    text = F.array_join(F.transform(F.array_sort("__errors"), lambda e: e["error"]), ", ")
    return grouped.select(*run, "part_no", "n_errors", text.alias("summary"))

"""Routing, predicates and run outcomes on the driver tables.

events are channel events (users are groups, errors with a small value are
exits); line items are the steps of a run (the order), returned ones failed and
lines 6 and 7 are deferred; orders are finished runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.functions.predicates import confirm_kind, contains, from_bot, if_else, mentions
from tidewatch.operators import outcomes, routing
from tidewatch.session import shared_folder
from tidewatch.sources.ticks import ticker_events


def us(column: str) -> Column:
    return F.unix_micros(column)


def channel(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        F.concat(F.lit("g"), "user_id").alias("group_id"),
        F.col("event_type").alias("kind"),
        ((F.col("event_type") == "error") & (F.col("value") < 20)).alias("is_exit"),
        F.floor("value").cast("int").alias("exit_code"),
        F.col("ts").alias("created_at"),
    )


CHANNEL_SQL = """
channel AS (SELECT event_id, 'g' || user_id AS group_id, event_type AS kind, event_type = 'error' AND value < 20 AS is_exit,
  CAST(floor(value) AS INTEGER) AS exit_code, ts AS created_at FROM events)
"""


def processes(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is a process of six groups."""
    nation = table(spark, sf, "nation")
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("g"), F.col("n_nationkey") + i * 25))
    return nation.select(F.explode(groups).alias("group_id"), F.col("n_name").alias("name"))


PROCESSES_SQL = "processes AS (SELECT 'g' || (n_nationkey + i * 25) AS group_id, n_name AS name FROM nation, range(6) t(i))"


# --- routing


@query(
    "route_ticker_events",
    """WITH spans AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
    SELECT user_id, CAST(n AS BIGINT) AS tick_no, epoch_us(a) + n * 3600000000 AS tick_us
    FROM spans, LATERAL (SELECT unnest(generate_series(1, (epoch_us(b) - epoch_us(a)) // 3600000000)) AS n) t""",
)
def ticks(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return ticker_events(spans, 3600).select("user_id", "tick_no", us("tick").alias("tick_us"))


@query(
    "route_fan_in",
    """SELECT 'orders' AS channel, o_orderkey AS id, epoch_us(o_orderdate) AS at_us, NULL AS kind FROM orders
    UNION ALL SELECT 'events', event_id, epoch_us(ts), event_type FROM events""",
)
def fan_in(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("orders").alias("channel"), F.col("o_orderkey").alias("id"), us("o_orderdate").alias("at_us"))
    ev = table(spark, sf, "events").select(
        F.lit("events").alias("channel"), F.col("event_id").alias("id"), us("ts").alias("at_us"), F.col("event_type").alias("kind")
    )
    return routing.fan_in(orders, ev)


@query("route_duplicate", "SELECT event_id, CAST(n AS BIGINT) AS copy FROM events, LATERAL (SELECT unnest(generate_series(1, event_id % 4)) AS n) t")
def duplicate(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return routing.duplicate(ev, F.col("event_id") % 4)


@query("route_broadcast_events", f"WITH {CHANNEL_SQL}, {PROCESSES_SQL} SELECT event_id, group_id, name AS process FROM channel JOIN processes USING (group_id)")
def broadcast_events(spark, sf):
    return routing.broadcast_events(channel(spark, sf), processes(spark, sf)).select("event_id", "group_id", "process")


ADMIT_SQL = """WITH ranked AS (
  SELECT event_id, event_type, epoch_us(date_trunc('day', ts)) AS window_us,
    row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS position FROM events)"""


@query("route_admit", f"{ADMIT_SQL} SELECT event_id, event_type, window_us, CAST(position AS INTEGER) AS position FROM ranked WHERE position <= 32")
def admit(spark, sf):
    admitted, _ = routing.admit(table(spark, sf, "events"), ["event_type"], "1 day", ["ts", "event_id"], routing.PROCESS_CAP)
    return admitted.select("event_id", "event_type", us("window_start").alias("window_us"), "position")


@query("route_admit_dropped", f"{ADMIT_SQL} SELECT event_id, event_type, window_us FROM ranked WHERE position > 32")
def admit_dropped(spark, sf):
    _, dropped = routing.admit(table(spark, sf, "events"), ["event_type"], "1 day", ["ts", "event_id"], routing.PROCESS_CAP)
    return dropped.select("event_id", "event_type", us("window_start").alias("window_us"))


@query(
    "route_admission_counts",
    f"""{ADMIT_SQL} SELECT event_type, window_us, count(*) FILTER (position <= 32) AS n_admitted, count(*) FILTER (position > 32) AS n_dropped
    FROM ranked GROUP BY ALL""",
)
def admission_counts(spark, sf):
    counts = routing.admission_counts(table(spark, sf, "events"), ["event_type"], "1 day", "ts", routing.PROCESS_CAP)
    return counts.select("event_type", us("window_start").alias("window_us"), "n_admitted", "n_dropped")


@query(
    "route_until_exit",
    f"""WITH {CHANNEL_SQL}, marked AS (SELECT *, coalesce(sum(CAST(is_exit AS INTEGER)) OVER (
      PARTITION BY group_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS exits FROM channel)
    SELECT event_id, group_id, is_exit FROM marked WHERE exits = 0""",
)
def until_exit(spark, sf):
    return routing.until_exit(channel(spark, sf), ["group_id"], ["created_at", "event_id"]).select("event_id", "group_id", "is_exit")


@query(
    "route_runs",
    f"""WITH {CHANNEL_SQL}, {PROCESSES_SQL}
    SELECT left(sha256(event_id || chr(31) || name), 8) AS run_id, name AS process, event_id, epoch_us(created_at) AS started_us
    FROM channel JOIN processes USING (group_id) WHERE NOT is_exit""",
)
def runs(spark, sf):
    delivered = routing.broadcast_events(channel(spark, sf), processes(spark, sf))
    return routing.runs(delivered).select("run_id", "process", "event_id", us("started_at").alias("started_us"))


@query(
    "route_live_versions",
    """WITH loads AS (SELECT o_custkey AS name, o_orderkey AS version, o_orderdate AS a,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 DAYS END AS f FROM orders),
    next AS (SELECT *, lead(a) OVER (PARTITION BY name ORDER BY a, version) AS b FROM loads)
    SELECT name, version, CASE WHEN b IS NULL THEN epoch_us(f) WHEN f IS NULL THEN epoch_us(b) ELSE epoch_us(least(b, f)) END AS valid_to_us,
      b IS NULL AND f IS NULL AS is_current FROM next""",
)
def live_versions(spark, sf):
    orders = table(spark, sf, "orders")
    loads = orders.select(
        F.col("o_custkey").alias("name"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("finished_at"),
    )
    return routing.live_versions(loads).select("name", "version", us("valid_to").alias("valid_to_us"), "is_current")


def finished(spark: SparkSession, sf: str) -> DataFrame:
    return as_finished(table(spark, sf, "orders"))


def as_finished(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("run"), "o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("process"),
        F.lit("org/r").alias("repo"),
        F.concat(F.lit("c"), "o_custkey").alias("commit"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 600)).alias("ended_at"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("exit status "), F.col("o_orderkey") % 7)).alias("error"),
    )


FINISHED_SQL = """
finished AS (SELECT 'run' || o_orderkey AS run_id, o_orderpriority AS process, 'org/r' AS repo, 'c' || o_custkey AS commit, o_orderdate AS started_at,
  o_orderdate + to_seconds(o_orderkey % 600) AS ended_at, CASE WHEN o_orderstatus = 'F' THEN 'exit status ' || (o_orderkey % 7) END AS error FROM orders)
"""


@query(
    "route_run_durations",
    f"""WITH {FINISHED_SQL}, timed AS (SELECT process, error IS NULL AS ok, (epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS s FROM finished)
    SELECT process, ok, count(*) AS n_runs, CAST(sum(s) AS DOUBLE) / count(*) AS avg_seconds, CAST(max(s) AS DOUBLE) AS max_seconds,
      CAST(quantile_disc(s, 0.5) AS DOUBLE) AS median_seconds FROM timed GROUP BY ALL""",
)
def run_durations(spark, sf):
    return routing.run_durations(finished(spark, sf))


@query(
    "route_merged_durations",
    f"""WITH {FINISHED_SQL}, timed AS (SELECT process, error IS NULL AS ok, (epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS s FROM finished)
    SELECT process, ok, count(*) AS n_runs, CAST(sum(s) AS DOUBLE) / count(*) AS avg_seconds, CAST(max(s) AS DOUBLE) AS max_seconds, TRUE AS median_holds
    FROM timed GROUP BY ALL""",
)
def merged_durations(spark, sf):
    """Daily sketches, written and merged on read; the median they give is held against the
    ranks of all runs."""
    done = finished(spark, sf)
    folder = shared_folder(spark, "durations")
    routing.duration_sketches(done).write.parquet(folder)
    merged = routing.merged_durations(spark.read.parquet(folder))
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000
    runs = done.select(F.col("process").alias("__p"), (F.coalesce("error", F.lit("")) == "").alias("__ok"), seconds.alias("__s"))
    same = F.col("process").eqNullSafe(F.col("__p")) & (F.col("ok") == F.col("__ok"))
    median = F.col("quantile_seconds")
    below, upto = F.avg((F.col("__s") < median).cast("double")), F.avg((F.col("__s") <= median).cast("double"))
    names = ["process", "ok", "n_runs", "avg_seconds", "max_seconds"]
    holds = (below <= 0.5 + routing.SKETCH_ERROR) & (upto >= 0.5 - routing.SKETCH_ERROR)
    return merged.join(runs, same).groupBy(*names).agg(holds.alias("median_holds"))


@query(
    "route_process_defaults",
    """WITH specs AS (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE s_name END AS name,
        CASE WHEN s_nationkey % 2 = 0 THEN 'ticker' ELSE '' END AS watch, CASE WHEN s_nationkey % 5 <> 0 THEN 'build' END AS run FROM supplier)
    SELECT s_suppkey, CASE WHEN name = '' THEN 'node-' || row_number() OVER (PARTITION BY name = '' ORDER BY s_suppkey) ELSE name END AS name,
      CASE WHEN watch = '' THEN 'oneshot' ELSE watch END AS watch, CASE WHEN run IS NULL THEN 'the process needs a run parameter' END AS error FROM specs""",
)
def process_defaults(spark, sf):
    supplier = table(spark, sf, "supplier")
    key = F.col("s_nationkey")
    specs = supplier.select(
        "s_suppkey",
        F.when(key % 3 == 0, "").otherwise(F.col("s_name")).alias("name"),
        F.when(key % 2 == 0, "ticker").otherwise("").alias("watch"),
        F.when(key % 5 != 0, "build").alias("run"),
    )
    return routing.process_defaults(specs, "node", ["s_suppkey"]).drop("run")


# --- predicates


@query(
    "check_contains",
    """SELECT o_orderkey, coalesce(list_contains(['F', NULL, o_orderpriority], o_orderstatus), false) AS has_status,
    coalesce(list_contains([NULL, '2-HIGH'], o_orderpriority), false) AS has_priority FROM orders""",
)
def contains_query(spark, sf):
    orders = table(spark, sf, "orders")
    null = F.lit(None).cast("string")
    return orders.select(
        "o_orderkey",
        contains(F.array(F.lit("F"), null, F.col("o_orderpriority")), F.col("o_orderstatus")).alias("has_status"),
        contains(F.array(null, F.lit("2-HIGH")), F.col("o_orderpriority")).alias("has_priority"),
    )


@query(
    "check_if_else",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderpriority ELSE o_orderstatus END AS chosen,
    CASE WHEN o_orderstatus = 'O' THEN o_totalprice > 100000 ELSE false END AS alone FROM orders""",
)
def if_else_query(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        "o_orderkey",
        if_else(F.col("o_totalprice") > 200000, F.col("o_orderpriority"), F.col("o_orderstatus")).alias("chosen"),
        if_else(F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100000).alias("alone"),
    )


@query(
    "check_confirm_kind",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'yes|yep|yeah|confirm|ok') THEN 'CONFIRM'
      WHEN regexp_matches(lower(text), 'no|abort|cancel') THEN 'ABORT' END AS kind FROM conversations""",
)
def confirm(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", confirm_kind(F.col("text")).alias("kind"))


@query(
    "check_from_bot_and_mentions",
    """SELECT conv_id, turn, role = 'system' OR turn % 5 = 4 AS is_bot, turn % 3 = 0 AS is_mention FROM conversations""",
)
def bots(spark, sf):
    c = table(spark, sf, "conversations")
    user = F.when(F.col("role") == "system", "BOT").otherwise(F.col("role"))
    bot_id = F.when(F.col("turn") % 5 == 4, "b1").otherwise("")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" <@BOT> hi"))).otherwise(F.concat(F.lit("<@BOTS> "), "text"))
    return c.select("conv_id", "turn", from_bot(user, bot_id, "BOT").alias("is_bot"), mentions(text, "BOT").alias("is_mention"))


# --- outcomes


def steps(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    long = lambda c: F.col(c).cast("long")
    return items.select(
        F.col("l_orderkey").alias("run_id"),
        (((long("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100 + long("l_quantity")).alias("seq_no"),
        (F.col("l_linenumber") >= 6).alias("is_deferred"),
        F.when(F.col("l_returnflag") == "R", F.concat_ws("-", F.lit("err"), "l_linenumber", "l_partkey")).alias("error"),
        F.concat_ws("-", F.lit("v"), "l_partkey", "l_suppkey").alias("value"),
        F.col("l_shipdate").alias("ended_at"),
    )


STEPS_SQL = """
steps AS (SELECT l_orderkey AS run_id, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq_no, l_linenumber >= 6 AS is_deferred,
  CASE WHEN l_returnflag = 'R' THEN concat_ws('-', 'err', l_linenumber, l_partkey) END AS error,
  concat_ws('-', 'v', l_partkey, l_suppkey) AS value, l_shipdate AS ended_at FROM lineitem),
walked AS (SELECT *, coalesce(sum(CASE WHEN NOT is_deferred AND error IS NOT NULL THEN 1 END) OVER (
  PARTITION BY run_id ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS reached FROM steps),
ran AS (SELECT *, row_number() OVER (PARTITION BY run_id, is_deferred ORDER BY seq_no DESC) AS from_end FROM walked WHERE is_deferred OR reached),
outcome AS (
  SELECT run_id, max(value) FILTER (NOT is_deferred AND from_end = 1) AS value,
    min(seq_no) FILTER (NOT is_deferred AND error IS NOT NULL) AS first_error_seq,
    count(*) FILTER (is_deferred) AS n_deferred_run, count(*) FILTER (is_deferred AND reached) AS n_reached,
    count(*) FILTER (is_deferred AND error IS NOT NULL) AS n_deferred_failed,
    count(*) FILTER (NOT is_deferred) AS n_ran FROM ran GROUP BY 1),
last_deferred AS (SELECT run_id, error FROM steps WHERE is_deferred AND error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq_no) = 1),
step_error AS (SELECT run_id, error FROM walked WHERE NOT is_deferred AND error IS NOT NULL AND reached)
"""


@query(
    "outcome_sequence",
    f"""WITH {STEPS_SQL}
    SELECT o.run_id, (SELECT count(*) FROM steps p WHERE p.run_id = o.run_id AND NOT p.is_deferred) AS n_plain, o.value, coalesce(d.error, s.error) AS error, d.error IS NULL AND s.error IS NULL AS ok, o.first_error_seq, o.n_deferred_run, o.n_deferred_failed
    FROM outcome o LEFT JOIN last_deferred d USING (run_id) LEFT JOIN step_error s USING (run_id)""",
)
def sequence(spark, sf):
    return outcomes.sequence_outcome(steps(spark, sf))


@query("outcome_sequence_counted_double", f"WITH {STEPS_SQL} SELECT run_id, n_deferred_run + n_reached AS n_deferred_run FROM outcome")
def sequence_double(spark, sf):
    return outcomes.sequence_outcome(steps(spark, sf), count_double=True).select("run_id", "n_deferred_run")


@query(
    "outcome_step_states",
    f"""WITH {STEPS_SQL} SELECT run_id, CASE WHEN is_deferred THEN 'deferred' WHEN NOT reached THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' ELSE 'ok' END AS state,
    reached, count(*) AS n FROM walked GROUP BY ALL""",
)
def states(spark, sf):
    return outcomes.step_states(steps(spark, sf)).groupBy("run_id", "state", "reached").agg(F.count("*").alias("n"))


def branches(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).withColumnRenamed("seq_no", "branch")


@query(
    "outcome_parallel",
    f"""WITH {STEPS_SQL}, first AS (SELECT run_id, error FROM steps WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ended_at, seq_no) = 1)
    SELECT s.run_id, bool_and(s.error IS NULL) AS ok, count(*) AS n_branches, count(s.error) AS n_failed, max(f.error) AS first_error
    FROM steps s LEFT JOIN first f USING (run_id) GROUP BY 1""",
)
def parallel(spark, sf):
    return outcomes.parallel_outcome(branches(spark, sf))


@query(
    "outcome_parallel_slots",
    f"""WITH {STEPS_SQL} SELECT run_id, seq_no AS branch, row_number() OVER (PARTITION BY run_id ORDER BY ended_at, seq_no) - 1 AS slot,
    CASE WHEN error IS NULL THEN value ELSE '' END AS value FROM steps""",
)
def slots(spark, sf):
    return outcomes.parallel_slots(branches(spark, sf)).select("run_id", "branch", F.col("slot").cast("long").alias("slot"), "value")


LIFECYCLE_SQL = f"""
{FINISHED_SQL}, statuses AS (
  SELECT run_id, repo, commit, process AS context, 1 AS status_no, 'pending' AS state, '' AS description, started_at AS ts FROM finished
  UNION ALL SELECT run_id, repo, commit, process, 2, CASE WHEN error IS NULL THEN 'success' ELSE 'failure' END, coalesce(error, 'CI executed successfully'), ended_at FROM finished)
"""


@query("outcome_status_lifecycle", f"WITH {LIFECYCLE_SQL} SELECT run_id, repo, commit, context, status_no, state, description, epoch_us(ts) AS ts_us FROM statuses")
def status_lifecycle(spark, sf):
    return outcomes.status_lifecycle(finished(spark, sf)).withColumn("ts_us", us("ts")).drop("ts")


@query(
    "outcome_latest_status",
    f"""WITH {LIFECYCLE_SQL} SELECT repo, commit, 'ci/' || context AS context, state, CASE WHEN description = '' THEN 'CI build ' || state ELSE description END AS description
    FROM statuses QUALIFY row_number() OVER (PARTITION BY repo, commit, context ORDER BY ts DESC, run_id DESC, status_no DESC) = 1""",
)
def latest_status(spark, sf):
    statuses = outcomes.status_lifecycle(finished(spark, sf)).withColumn("tie", F.struct("run_id", "status_no"))
    return outcomes.latest_status(statuses, tie="tie", base="").drop("ts")


@query(
    "outcome_chat_lifecycle",
    f"""WITH {FINISHED_SQL} SELECT run_id, 1 AS message_no, ':shipit: Started action, check logs at .' AS text FROM finished
    UNION ALL SELECT run_id, 2, ':collision: Action failed with ' || error || '.' FROM finished WHERE error IS NOT NULL
    UNION ALL SELECT run_id, 3, ':heavy_check_mark: Action completed successfully.' FROM finished""",
)
def chat_lifecycle(spark, sf):
    return outcomes.chat_lifecycle(finished(spark, sf))


@query(
    "outcome_exit_codes",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 256 AS INTEGER) ELSE -1 END AS exit_code FROM orders""",
)
def exit_codes(spark, sf):
    orders = table(spark, sf, "orders")
    error = F.when(F.col("o_orderstatus") != "O", "failed")
    code = F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 256).cast("int"))
    return orders.select("o_orderkey", outcomes.exit_code(error, code).alias("exit_code"))


@query(
    "outcome_group_exit_codes",
    f"""WITH {CHANNEL_SQL} SELECT group_id, exit_code FROM channel WHERE is_exit
    QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, event_id DESC) = 1""",
)
def group_exit_codes(spark, sf):
    return outcomes.group_exit_codes(channel(spark, sf).filter("is_exit"))


FLEET_SQL = """
results AS (SELECT l_orderkey AS run_id, 'h' || (l_suppkey % 3) AS host, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq_no,
  CASE WHEN l_returnflag = 'R' THEN concat_ws('-', 'err', l_linenumber, l_partkey) END AS error, concat_ws('-', 'v', l_partkey, l_suppkey) AS value, l_shipdate AS ended_at FROM lineitem),
hosts AS (SELECT DISTINCT run_id, host FROM results UNION SELECT o_orderkey, 'h9' FROM orders WHERE o_orderstatus = 'P'),
commands AS (SELECT o_orderkey AS run_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
walked AS (SELECT *, coalesce(sum(CASE WHEN error IS NOT NULL THEN 1 END) OVER (
  PARTITION BY run_id, host ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS reached FROM results),
last_step AS (SELECT * FROM walked WHERE reached QUALIFY row_number() OVER (PARTITION BY run_id, host ORDER BY seq_no DESC) = 1),
last_end AS (SELECT run_id, host, max(ended_at) AS ended_at FROM results GROUP BY ALL),
per_host AS (SELECT h.run_id, h.host, s.value, s.error, s.error IS NULL AS ok, e.ended_at
  FROM hosts h LEFT JOIN last_step s USING (run_id, host) LEFT JOIN last_end e USING (run_id, host))
"""


def fleet(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers modulo three are the hosts of an order, its lines the results;
    pending orders have a host that ran nothing, failed ones no commands."""
    results = steps(spark, sf).withColumn("host", F.concat(F.lit("h"), F.floor(F.col("seq_no") / 100) % 100_000 % 3))
    orders = table(spark, sf, "orders")
    idle = orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("run_id"), F.lit("h9").alias("host"))
    hosts = results.select("run_id", "host").unionByName(idle)
    commands = orders.filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("seq_no"))
    return outcomes.fleet_outcome(hosts, commands, results)


@query("outcome_fleet_hosts", f"WITH {FLEET_SQL} SELECT run_id, host, value, error, epoch_us(ended_at) AS ended_us FROM per_host")
def fleet_hosts(spark, sf):
    per_host, _ = fleet(spark, sf)
    return per_host.select("run_id", "host", "value", "error", us("ended_at").alias("ended_us"))


@query(
    "outcome_fleet_runs",
    f"""WITH {FLEET_SQL}, first AS (SELECT run_id, error FROM per_host WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ended_at, host) = 1),
    n AS (SELECT run_id, count(*) AS n_hosts, count(error) AS n_failed FROM per_host GROUP BY 1)
    SELECT run_id, coalesce(n_hosts, 0) AS n_hosts, coalesce(c.n, 0) AS n_commands, coalesce(n_failed, 0) AS n_failed,
      CASE WHEN c.n IS NULL THEN 'provide at least one session action' WHEN n_hosts IS NULL THEN 'a session needs at least one host' ELSE f.error END AS error,
      c.n IS NOT NULL AND n_hosts IS NOT NULL AND f.error IS NULL AS ok
    FROM n FULL JOIN commands c USING (run_id) LEFT JOIN first f USING (run_id)""",
)
def fleet_runs(spark, sf):
    _, per_run = fleet(spark, sf)
    return per_run


@query(
    "outcome_error_rows",
    f"WITH {STEPS_SQL} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq_no) AS error_no, error FROM steps WHERE error IS NOT NULL",
)
def error_rows(spark, sf):
    rows = outcomes.error_rows(steps(spark, sf), ["run_id"], ["seq_no"])
    return rows.withColumn("error_no", F.col("error_no").cast("long"))


@query(
    "outcome_error_summary",
    f"""WITH {STEPS_SQL}, numbered AS (SELECT run_id, error, seq_no, row_number() OVER (PARTITION BY run_id ORDER BY seq_no) AS error_no FROM steps WHERE error IS NOT NULL)
    SELECT run_id, (error_no - 1) // 2 + 1 AS part_no, count(*) AS n_errors, string_agg(error, ', ' ORDER BY seq_no) AS summary FROM numbered GROUP BY 1, 2""",
)
def error_summary(spark, sf):
    return outcomes.error_summary(steps(spark, sf), ["run_id"], ["seq_no"], part_size=2)

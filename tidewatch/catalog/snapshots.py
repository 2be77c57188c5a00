"""Snapshot diffs, upserts and cluster jobs on the driver tables.

orders play the objects and pods: the old snapshot lacks the low-priority ones,
and every order's status decides how its pod moved on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.catalog.running import us
from tidewatch.operators import builds, diffs, jobs
from tidewatch.sources.files import file_changes

NOW = "2002-01-01 00:00:00"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    old = orders.filter(F.col("o_orderpriority") != "5-LOW")
    altered = F.when(F.col("o_totalprice") > 250000, "X").otherwise(F.col("o_orderstatus"))
    return old, orders.filter(F.col("o_orderpriority") != "1-URGENT").withColumn("o_orderstatus", altered)


@query(
    "diff_snapshot",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'ADDED' ELSE 'CHANGED' END AS change,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS old_o_orderstatus
    FROM orders WHERE o_orderpriority <> '1-URGENT' AND (o_orderpriority = '5-LOW' OR o_totalprice > 250000)""",
)
def snapshot(spark, sf):
    old, new = _snapshots(spark, sf)
    keys, compared = ["o_orderkey"], ["o_orderstatus"]
    return diffs.snapshot_diff(old, new.select(*keys, *compared), keys, compared)


@query(
    "diff_file_changes",
    """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'REMOVE' ELSE 'WRITE' END AS op
    FROM orders WHERE o_orderpriority <> '5-LOW' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 250000)""",
)
def files(spark, sf):
    old, new = _snapshots(spark, sf)

    def listing(df: DataFrame, grown: Column) -> DataFrame:
        return df.select(F.concat(F.lit("f"), "o_orderkey").alias("path"), (F.col("o_custkey") + grown).alias("length"), F.col("o_orderdate").alias("mtime"))

    return file_changes(listing(old, F.lit(0)), listing(new, F.when(F.col("o_orderstatus") == "X", 1).otherwise(0)))


def _pods(spark: SparkSession, sf: str, is_new: bool) -> DataFrame:
    orders = table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")

    def container(name: str, state: Column, restarts: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            state.alias("state"),
            restarts.cast("int").alias("restarts"),
            (F.col("o_orderkey") % 256).cast("int").alias("exit_code"),
            F.col("o_orderdate").alias("started_at"),
            (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 600)).alias("finished_at"),
            F.lit("Error").alias("reason"),
        )

    if is_new:
        state = F.when(status == "F", "terminated").otherwise("running")
        phase = F.when(status == "F", "Failed").when(status == "O", "Running").otherwise("Pending")
        restarts = F.when(priority == "1-URGENT", 1).otherwise(0)
    else:
        state, phase, restarts = F.when(status == "O", "waiting").otherwise("running"), F.lit("Pending"), F.lit(0)
    main = container("main", F.when(priority == "4-NOT SPECIFIED", "unknown").otherwise(state), restarts)
    side = container("side", F.lit("waiting"), F.lit(0))
    has_side = F.lit(True) if is_new else priority != "3-MEDIUM"
    pods = orders.select(
        F.concat(F.lit("ns"), F.col("o_custkey") % 5).alias("namespace"),
        F.concat(F.lit("pod"), "o_orderkey").alias("name"),
        phase.alias("phase"),
        F.when(has_side, F.array(main, side)).otherwise(F.array(main)).alias("containers"),
        priority.alias("priority"),
    )
    return pods if is_new else pods.filter("priority <> '5-LOW'")


PODS_SQL = f"""
pods AS (
  SELECT 'ns' || (o_custkey % 5) AS namespace, 'pod' || o_orderkey AS name, o_orderpriority = '5-LOW' AS is_added, o_orderpriority AS priority,
    'Pending' AS old_phase, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' ELSE 'Pending' END AS phase,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'waiting' ELSE 'running' END AS old_state,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'terminated' ELSE 'running' END AS state,
    o_orderpriority = '1-URGENT' AS restarted, o_orderkey % 256 AS code, o_orderkey % 600 AS s,
    'running for ' || (epoch_us(TIMESTAMP '{NOW}') - epoch_us(o_orderdate)) // 3600000000 || 'h0m0s' AS running
  FROM orders),
changes AS (
  SELECT *, 'main' AS container FROM pods WHERE is_added OR old_state <> state OR state = 'unknown' OR restarted
  UNION ALL SELECT *, 'side' FROM pods WHERE is_added OR priority = '3-MEDIUM')
"""


@query(
    "diff_containers",
    f"""WITH {PODS_SQL} SELECT namespace, name AS pod, is_added, container AS name,
      CASE WHEN is_added OR container = 'side' THEN NULL ELSE old_state END AS old_state, CASE WHEN container = 'side' THEN 'waiting' ELSE state END AS new_state FROM changes""",
)
def containers(spark, sf):
    changed = diffs.container_diff(_pods(spark, sf, False), _pods(spark, sf, True))
    return changed.select("namespace", "pod", "is_added", "name", F.col("old.state").alias("old_state"), F.col("new.state").alias("new_state"))


@query(
    "diff_log_streams",
    f"""WITH {PODS_SQL} SELECT namespace, name AS pod, container AS name FROM changes WHERE container = 'main' AND state IN ('running', 'terminated')""",
)
def log_streams(spark, sf):
    return diffs.log_streams_to_open(diffs.container_diff(_pods(spark, sf, False), _pods(spark, sf, True)), first_check=True)


@query(
    "diff_describe_changes",
    f"""WITH {PODS_SQL}, words AS (
      SELECT *, CASE WHEN container = 'side' THEN 'waiting to start' WHEN state = 'running' THEN running WHEN state = 'unknown' THEN '<unknown>' ELSE
          'terminated with exit code ' || code || ' after running for ' || (CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm' || (s % 60) || 's' END) || ', reason: Error' END AS now_text,
        CASE old_state WHEN 'waiting' THEN 'waiting to start' WHEN 'running' THEN running ELSE '<unknown>' END AS old_text FROM changes),
    lines AS (
      SELECT namespace, name, 0 AS part, 'Created Pod ' || name || ' in namespace ' || namespace || '.' AS text FROM pods WHERE is_added
      UNION ALL SELECT namespace, name, 1, 'Pod ' || name || ' in namespace ' || namespace || ', has changed state from "Pending" to "' || phase || '".' FROM pods WHERE NOT is_added AND phase <> old_phase
      UNION ALL SELECT namespace, name, CASE container WHEN 'main' THEN 2 ELSE 3 END,
        CASE WHEN is_added OR container = 'side' THEN 'Container ' || container || ' created, current state is "' || now_text || '".'
          WHEN restarted THEN 'Container "main" restarted, current state is "' || now_text || '".'
          ELSE 'Container "main" changed status from "' || old_text || '" to "' || now_text || '".' END FROM words)
    SELECT namespace, name, CAST(row_number() OVER (PARTITION BY namespace, name ORDER BY part) - 1 AS INTEGER) AS line_no, text FROM lines""",
)
def describe(spark, sf):
    changed = diffs.pod_diff(_pods(spark, sf, False), _pods(spark, sf, True))
    return diffs.describe_changes(changed, F.lit(NOW).cast("timestamp"))


def _objects(df: DataFrame, is_desired: bool) -> DataFrame:
    kind = F.when(F.col("o_custkey") % 4 == 0, "Service").when(F.col("o_custkey") % 4 == 1, "Deployment").when(F.col("o_custkey") % 4 == 2, "Job").otherwise("Pod")
    own = F.lit(None).cast("string")
    return df.select(
        kind.alias("kind"),
        F.concat(F.lit("o"), "o_orderkey").alias("name"),
        F.concat(F.lit("new " if is_desired else "old "), "o_orderstatus").alias("spec"),
        (own if is_desired else F.concat(F.lit("10.0.0."), F.col("o_orderkey") % 256)).alias("cluster_ip"),
        (own if is_desired else F.concat(F.lit("v"), "o_custkey")).alias("resource_version"),
    )


@query(
    "upsert_objects",
    """WITH o AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'Service' WHEN 1 THEN 'Deployment' WHEN 2 THEN 'Job' ELSE 'Pod' END AS kind,
      o_orderpriority <> '5-LOW' AS cur, o_orderpriority <> '1-URGENT' AS want, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS status FROM orders)
    SELECT kind, 'o' || o_orderkey AS name, CASE WHEN want THEN 'new ' || status ELSE 'old ' || o_orderstatus END AS spec,
      CASE WHEN cur AND (kind = 'Service' OR NOT want) THEN '10.0.0.' || (o_orderkey % 256) END AS cluster_ip,
      CASE WHEN cur AND (kind = 'Service' OR NOT want) THEN 'v' || o_custkey END AS resource_version,
      CASE WHEN cur AND want THEN 'UPDATE' WHEN want THEN 'CREATE' ELSE 'KEEP' END AS action FROM o""",
)
def upsert(spark, sf):
    old, new = _snapshots(spark, sf)
    return diffs.upsert_objects(_objects(old, False), _objects(new, True), ["kind", "name"])


@query("upsert_unsupported", "SELECT 'o' || o_orderkey AS name, 'object Pod is not supported' AS error FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 4 = 3")
def unsupported(spark, sf):
    _, new = _snapshots(spark, sf)
    return diffs.unsupported_objects(_objects(new, True)).select("name", "error")


# --- jobs


@query(
    "job_owned_pods",
    """SELECT 'ns' || (c_custkey % 25) AS namespace, 'pod' || o_orderkey AS name, c_name AS job FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus <> 'P' AND (o_orderpriority <> '1-URGENT' OR c_mktsegment = 'BUILDING') AND (o_orderpriority = '1-URGENT' OR c_mktsegment = 'MACHINERY')""",
)
def owned_pods(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    wanted = customer.select(
        F.concat(F.lit("ns"), F.col("c_custkey") % 25).alias("namespace"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("u"), "c_custkey").alias("uid"),
        F.create_map(F.lit("job-name"), F.col("c_name"), F.lit("tier"), F.col("c_mktsegment")).alias("selector"),
    )
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").otherwise("MACHINERY")
    owner_kind = F.when(F.col("o_orderstatus") == "P", "ReplicaSet").otherwise("Job")
    pods = orders.select(
        F.concat(F.lit("ns"), F.col("o_custkey") % 25).alias("namespace"),
        F.concat(F.lit("pod"), "o_orderkey").alias("name"),
        F.create_map(F.lit("job-name"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), F.lit("tier"), tier, F.lit("x"), F.lit("y")).alias("labels"),
        F.array(
            F.struct(F.lit("Node").alias("kind"), F.lit("u0").alias("uid")), F.struct(owner_kind.alias("kind"), F.concat(F.lit("u"), "o_custkey").alias("uid"))
        ).alias("owners"),
    )
    return jobs.owned_pods(pods, wanted).select("namespace", "name", "job")


@query(
    "job_outcome",
    """WITH decisive AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' OR (event_type = 'signup' AND value > 100) THEN 'success' ELSE 'failure' END AS outcome
      FROM events WHERE event_type IN ('purchase', 'error') OR (event_type = 'signup' AND value > 100))
    SELECT 'job' || user_id AS name, outcome, CASE WHEN outcome = 'failure' THEN 'broken at ' || event_id ELSE '' END AS message, epoch_us(ts) AS decided_us
    FROM decisive QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def job_outcome(spark, sf):
    ev = table(spark, sf, "events")
    kind = F.col("event_type")

    def condition(name: str, message: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), message.alias("message"))

    failed = condition("Failed", F.concat(F.lit("broken at "), "event_id"))
    done = condition("Complete", F.lit("done"))
    conditions = (
        F.when(kind == "purchase", F.array(done))
        .when(kind == "error", F.array(condition("Suspended", F.lit("")), failed))
        .when((kind == "signup") & (F.col("value") > 100), F.array(failed, done))
        .otherwise(F.array().cast("array<struct<type:string,message:string>>"))
    )
    log = ev.select(F.lit("ns").alias("namespace"), F.concat(F.lit("job"), "user_id").alias("name"), "ts", "event_id", conditions.alias("conditions"))
    return jobs.job_outcome(log, ["ts", "event_id"]).select("name", "outcome", "message", us("decided_at").alias("decided_us"))


@query(
    "job_complete",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 4 > 0 AND o_custkey % 2 = 0 ELSE o_orderkey % 4 >= 2 END AS complete FROM orders""",
)
def job_complete(spark, sf):
    orders = table(spark, sf, "orders")
    status = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", 2).alias("completions"),
        (F.col("o_orderkey") % 4).alias("succeeded"),
        (F.col("o_custkey") % 2).alias("active"),
    )
    return jobs.job_complete(status).select("o_orderkey", "complete")


@query(
    "job_defaults",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'CronJob' ELSE 'Job' END AS kind, CASE WHEN p_brand = 'Brand#1' THEN 'prod' ELSE 'default' END AS namespace,
      CASE WHEN p_size = 7 THEN 3 ELSE 0 END AS backoff_limit, CASE WHEN p_type = 'SMALL' THEN 'OnFailure' ELSE 'Never' END AS restart_policy, 28800 AS ttl_seconds,
      CASE WHEN p_size = 9 THEN 60 ELSE 14400 END AS deadline_seconds, CASE WHEN p_size < 10 THEN 'IfNotPresent,Always' ELSE 'Always,Always' END AS pull_policies FROM part""",
)
def job_defaults(spark, sf):
    part = table(spark, sf, "part")
    container = lambda policy: F.struct(F.lit("c").alias("name"), policy.alias("image_pull_policy"))
    given = part.select(
        "p_partkey",
        F.when(F.col("p_size") > 25, "CronJob").otherwise("").alias("kind"),
        F.when(F.col("p_brand") == "Brand#1", "prod").alias("namespace"),
        F.when(F.col("p_size") == 7, 3).alias("backoff_limit"),
        F.when(F.col("p_type") == "SMALL", "OnFailure").alias("restart_policy"),
        F.lit(None).cast("int").alias("ttl_seconds"),
        F.when(F.col("p_size") == 9, 60).alias("deadline_seconds"),
        F.array(container(F.when(F.col("p_size") < 10, "IfNotPresent").otherwise("")), container(F.lit(None).cast("string"))).alias("containers"),
    )
    full = jobs.job_defaults(given)
    return full.withColumn("pull_policies", F.array_join(F.col("containers.image_pull_policy"), ",")).drop("containers")


@query(
    "job_requested_resources",
    """WITH q AS (SELECT p_brand, p_type, p_size FROM part), sums AS (SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS s, count(*) AS n FROM q GROUP BY ALL)
    SELECT p_brand AS namespace, p_type AS name, 'cpu' AS resource, s + n * 1500 AS requested_milli, n * 2000 AS limited_milli FROM sums
    UNION ALL SELECT p_brand, p_type, 'memory', s * 1048576 * 1000, NULL FROM sums""",
)
def requested_resources(spark, sf):
    part = table(spark, sf, "part")
    nothing = F.lit(None).cast("map<string,string>")
    first = F.struct(
        F.create_map(F.lit("cpu"), F.concat("p_size", F.lit("m")), F.lit("memory"), F.concat("p_size", F.lit("Mi"))).alias("requests"),
        F.create_map(F.lit("cpu"), F.lit("2")).alias("limits"),
    )
    second = F.struct(F.create_map(F.lit("cpu"), F.lit("1.5")).alias("requests"), nothing.alias("limits"))
    wanted = part.select(F.col("p_brand").alias("namespace"), F.col("p_type").alias("name"), F.array(first, second).alias("containers"))
    milli = lambda c: (F.col(c) * 1000).cast("long").alias(f"{c}_milli")
    return jobs.requested_resources(wanted).select("namespace", "name", "resource", milli("requested"), milli("limited"))


# --- builds


@query(
    "build_prune_report",
    """SELECT o_orderpriority AS description, count(*) AS n_records, CAST(sum(o_orderkey * 1024) AS BIGINT) AS bytes FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""",
)
def prune_report(spark, sf):
    orders = table(spark, sf, "orders")
    usage = orders.select(
        F.concat(F.lit("sha"), "o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "O").alias("in_use"),
        (F.col("o_orderkey") * 1024).alias("size"),
        F.col("o_orderpriority").alias("description"),
    )
    return builds.prune_report(usage, ["description"])


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every order reports two vertexes (its customer's and its own), one status
    and, when it failed, a log line."""
    orders = table(spark, sf, "orders")
    failed = F.col("o_orderstatus") == "F"

    def vertex(digest: Column, cached: Column) -> Column:
        return F.struct(
            digest.alias("digest"),
            F.array().cast("array<string>").alias("inputs"),
            F.col("o_orderpriority").alias("name"),
            F.col("o_orderdate").alias("started"),
            (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 90)).alias("completed"),
            F.when(failed, "exit 1").otherwise("").alias("error"),
            cached.alias("cached"),
        )

    status = F.struct(
        F.concat(F.lit("s"), "o_orderkey").alias("id"),
        F.concat(F.lit("v"), "o_custkey").alias("vertex"),
        F.col("o_custkey").alias("total"),
        F.col("o_orderkey").alias("current"),
        F.col("o_orderdate").alias("ts"),
    )
    log = F.struct(F.concat(F.lit("v"), "o_custkey").alias("vertex"), F.lit(2).alias("stream"), F.concat(F.lit("failed "), "o_orderkey").alias("data"), F.col("o_orderdate").alias("ts"))
    return orders.select(
        "o_orderkey",
        F.array(vertex(F.concat(F.lit("v"), "o_custkey"), F.col("o_orderstatus") == "P"), vertex(F.concat(F.lit("w"), "o_orderkey"), F.lit(False))).alias("vertexes"),
        F.array(status).alias("statuses"),
        F.when(failed, F.array(log)).alias("logs"),
    )


@query(
    "build_vertexes",
    """SELECT o_orderkey, d AS digest, o_orderpriority AS name, o_orderstatus = 'P' AND d[1] = 'v' AS cached FROM orders, LATERAL (SELECT unnest(['v' || o_custkey, 'w' || o_orderkey]) AS d) t""",
)
def vertexes(spark, sf):
    found, _, _ = builds.build_progress(responses(spark, sf), ["o_orderkey"])
    return found.select("o_orderkey", "digest", "name", "cached")


@query("build_statuses", "SELECT 's' || o_orderkey AS id, 'v' || o_custkey AS vertex, o_custkey AS total, o_orderkey AS current FROM orders")
def statuses(spark, sf):
    _, found, _ = builds.build_progress(responses(spark, sf))
    return found.drop("ts")


@query("build_logs", "SELECT 'v' || o_custkey AS vertex, 2 AS stream, 'failed ' || o_orderkey AS data FROM orders WHERE o_orderstatus = 'F'")
def logs(spark, sf):
    _, _, found = builds.build_progress(responses(spark, sf))
    return found.drop("ts")


@query(
    "build_vertex_summary",
    """WITH v AS (SELECT unnest(['v' || o_custkey, 'w' || o_orderkey]) AS digest, o_orderstatus AS st, o_orderkey % 90 AS s FROM orders)
    SELECT digest, count(*) AS n_updates, count(*) FILTER (st = 'P' AND digest[1] = 'v') AS n_cached, count(*) FILTER (st = 'F') AS n_failed, CAST(sum(s) AS DOUBLE) AS seconds FROM v GROUP BY 1""",
)
def vertex_summary(spark, sf):
    found, _, _ = builds.build_progress(responses(spark, sf))
    return builds.vertex_summary(found)

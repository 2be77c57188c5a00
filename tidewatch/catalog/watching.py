"""Repository watching on the driver tables.

events play the poll log: each user is a pull request, each hour a poll; nations
play the repositories with their rules and teams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.functions.predicates import matches_branch
from tidewatch.functions.text import short_id
from tidewatch.operators import changes, outcomes, routing, triggers

START = "2024-01-02 00:00:00"


def start():
    return F.lit(START).cast("timestamp")


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two watches per repository: one on the default branches, one on release. The
    latter needs approval where the former does not."""
    nation = table(spark, sf, "nation").withColumn("name", F.explode(F.array(F.lit("main"), F.lit("release"))))
    return nation.select(
        F.concat_ws("/", F.lit("w"), "n_nationkey", "name").alias("watch"),
        F.concat(F.lit("org/r"), "n_nationkey").alias("repo"),
        ((F.col("n_regionkey") % 2 == 0) == (F.col("name") == "main")).alias("approval_required"),
        F.array(F.concat(F.lit("org/t"), F.when(F.col("name") == "main", F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5))).alias("teams"),
        F.when(F.col("name") == "main", "").otherwise("^rel").alias("branch_pattern"),
    )


def team_members(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return nation.select(
        F.lit("org").alias("org"),
        F.concat(F.lit("t"), "n_regionkey").alias("slug"),
        F.concat(F.lit("u"), F.col("n_nationkey") % 5).alias("login"),
    )


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pull request and poll: the last event of the hour."""
    ev = table(spark, sf, "events")
    is_comment = F.col("event_type").isin("error", "signup")
    state = F.struct(
        F.concat(F.lit("c"), F.floor(F.col("value") / 10)).alias("oid"),
        (F.col("ts") - F.make_dt_interval(mins=F.round("value").cast("int"))).alias("committed_at"),
        F.when(F.col("event_type") == "view", "wip, skip ci").otherwise(F.concat(F.lit("change "), "event_id")).alias("message"),
        F.when(is_comment, F.concat(F.lit("m"), "event_id")).alias("comment_id"),
        F.when(is_comment, F.col("ts")).alias("comment_at"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("please retest this "), "event_id"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("ok to test "), "event_id"))
        .alias("comment_body"),
    )
    number = F.col("user_id")
    newest = ev.groupBy(F.date_trunc("hour", "ts").alias("poll_ts"), number.alias("number")).agg(
        F.max_by(state, F.struct("ts", "event_id")).alias("s")
    )
    return newest.select(
        "poll_ts",
        F.concat(F.lit("org/r"), F.col("number") % 25).alias("repo"),
        "number",
        F.when(F.col("number") % 7 == 0, "release").otherwise("master").alias("base_ref"),
        "s.*",
        F.concat(F.lit("u"), F.col("number") % 3).alias("author_login"),
        F.when(F.col("s.comment_id").isNotNull(), F.concat(F.lit("u"), F.col("number") % 4)).alias("comment_author"),
    )


RULES_SQL = """
rules AS (
  SELECT 'w/' || n_nationkey || '/' || name AS watch, 'org/r' || n_nationkey AS repo, (n_regionkey % 2 = 0) = (name = 'main') AS approval_required,
    CASE WHEN name = 'main' THEN 'master' ELSE '^rel' END AS pattern, CASE WHEN name = 'main' THEN n_regionkey ELSE (n_regionkey + 1) % 5 END AS team
  FROM nation, (SELECT unnest(['main', 'release']) AS name)),
approvers AS (
  SELECT DISTINCT r.watch, 'u' || (m.n_nationkey % 5) AS login
  FROM rules r JOIN nation m ON m.n_regionkey = r.team)
"""

POLLS_SQL = """
polls AS (
  SELECT date_trunc('hour', ts) AS poll_ts, 'org/r' || (user_id % 25) AS repo, user_id AS number,
    CASE WHEN user_id % 7 = 0 THEN 'release' ELSE 'master' END AS base_ref,
    'c' || CAST(floor(value / 10) AS BIGINT) AS oid,
    ts - to_minutes(CAST(round(value) AS INTEGER)) AS committed_at,
    CASE WHEN event_type = 'view' THEN 'wip, skip ci' ELSE 'change ' || event_id END AS message,
    CASE WHEN event_type IN ('error', 'signup') THEN 'm' || event_id END AS comment_id,
    CASE WHEN event_type IN ('error', 'signup') THEN ts END AS comment_at,
    CASE WHEN event_type = 'error' THEN 'please retest this ' || event_id
         WHEN event_type = 'signup' THEN 'ok to test ' || event_id END AS comment_body,
    'u' || (user_id % 3) AS author_login,
    CASE WHEN event_type IN ('error', 'signup') THEN 'u' || (user_id % 4) END AS comment_author
  FROM events
  QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id ORDER BY ts DESC, event_id DESC) = 1)
"""

UPDATES_SQL = f"""
matching AS (
  SELECT p.*, r.watch, greatest(committed_at, coalesce(comment_at, committed_at)) AS last_updated
  FROM polls p JOIN rules r USING (repo) WHERE regexp_matches(base_ref, r.pattern)),
-- a replay, one poll of every watch after the other: mark and versions as state
listed AS (
  SELECT watch, poll_ts, row_number() OVER (PARTITION BY watch ORDER BY poll_ts) AS k,
    list({{'number': number, 'updated': last_updated, 'committed': committed_at, 'oid': oid, 'body': coalesce(comment_body, ''),
      'commented': coalesce(comment_id, '') <> ''}}) AS rows
  FROM matching GROUP BY watch, poll_ts),
replay AS (
  SELECT watch, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS poll_ts, TIMESTAMP '{START}' AS mark, TIMESTAMP '{START}' AS next_mark,
    CAST(MAP {{}} AS MAP(BIGINT, STRUCT(oid VARCHAR, body VARCHAR))) AS versions,
    CAST([] AS STRUCT(number BIGINT, updated TIMESTAMP, new_commit BOOLEAN, new_comment BOOLEAN)[]) AS news
  FROM (SELECT DISTINCT watch FROM listed)
  UNION ALL
  SELECT watch, k, poll_ts, mark, greatest(mark, coalesce(list_max(list_transform(news, lambda n: n.updated)), mark)),
    map_concat(versions, map_from_entries(list_transform(kept, lambda x: {{'k': x.number, 'v': {{'oid': x.oid, 'body': x.body}}}}))), news
  FROM (
    SELECT *, list_filter(list_transform(kept, lambda x: {{'number': x.number, 'updated': x.updated,
        'new_commit': CASE WHEN map_extract(versions, x.number)[1] IS NULL THEN x.committed > mark ELSE map_extract(versions, x.number)[1].oid <> x.oid END,
        'new_comment': CASE WHEN map_extract(versions, x.number)[1] IS NULL THEN x.commented ELSE map_extract(versions, x.number)[1].body <> x.body END}}),
      lambda n: n.new_commit OR n.new_comment) AS news
    FROM (
      SELECT l.watch, l.k, l.poll_ts, r.next_mark AS mark, r.versions, list_filter(l.rows, lambda x: x.updated > r.next_mark) AS kept
      FROM replay r JOIN listed l ON l.watch = r.watch AND l.k = r.k + 1))),
found AS (SELECT watch, poll_ts, mark, unnest(news) AS n FROM replay),
updates AS (
  SELECT m.*, f.mark, f.n.new_commit AS new_commit, f.n.new_comment AS new_comment
  FROM found f JOIN matching m ON m.watch = f.watch AND m.poll_ts = f.poll_ts AND m.number = f.n.number)
"""

FIRED_SQL = """
judged AS (
  SELECT u.* EXCLUDE (repo), u.repo, r.approval_required, a.login IS NOT NULL AS by_approver
  FROM updates u JOIN rules r USING (watch) LEFT JOIN approvers a ON a.watch = u.watch AND a.login = u.comment_author),
fired AS (
  SELECT * FROM (
    SELECT *, CASE
      WHEN new_comment AND regexp_matches(coalesce(comment_body, ''), '.*retest this.*') AND (NOT approval_required OR by_approver) THEN 'retest'
      WHEN new_comment AND approval_required AND by_approver AND regexp_matches(coalesce(comment_body, ''), '.*ok to test.*') THEN 'approval'
      WHEN new_commit AND NOT regexp_matches(message, '.*skip ci.*') THEN 'commit' END AS trigger
    FROM judged) WHERE trigger IS NOT NULL)
"""

COMMENTS_SQL = """
comments AS (
  SELECT 'org/r' || (user_id % 25) AS repo, user_id AS number, event_id AS position, 'u' || (event_id % 6) AS login,
    CASE WHEN event_type = 'signup' THEN 'ok to test ' || event_id ELSE event_type END AS body
  FROM events),
approvals AS (
  SELECT r.watch, c.number, c.login, c.body FROM comments c JOIN rules r USING (repo) JOIN approvers a ON a.watch = r.watch AND a.login = c.login
  WHERE r.approval_required AND regexp_matches(c.body, '.*ok to test.*')
  QUALIFY row_number() OVER (PARTITION BY r.watch, c.number ORDER BY c.position) = 1),
gated AS (
  SELECT f.*, CASE WHEN f.approval_required AND o.login IS NULL THEN p.login END AS approved_by,
    CASE WHEN f.approval_required AND o.login IS NULL THEN p.body END AS approval_body
  FROM fired f LEFT JOIN approvers o ON o.watch = f.watch AND o.login = f.author_login
  LEFT JOIN approvals p ON p.watch = f.watch AND p.number = f.number
  WHERE NOT f.approval_required OR o.login IS NOT NULL OR p.login IS NOT NULL)
"""

WITH_UPDATES = f"WITH RECURSIVE {RULES_SQL}, {POLLS_SQL}, {UPDATES_SQL}"


def updates(spark: SparkSession, sf: str) -> DataFrame:
    return changes.pull_request_updates(polls(spark, sf), rules(spark, sf), start())


def approvers(spark: SparkSession, sf: str) -> DataFrame:
    return changes.approvers(team_members(spark, sf), rules(spark, sf))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        F.concat(F.lit("org/r"), F.col("user_id") % 25).alias("repo"),
        F.col("user_id").alias("number"),
        F.col("event_id").alias("position"),
        F.concat(F.lit("u"), F.col("event_id") % 6).alias("author_login"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("ok to test "), "event_id")).otherwise(F.col("event_type")).alias("body"),
    )


def fired(spark: SparkSession, sf: str) -> DataFrame:
    return triggers.pr_triggers(updates(spark, sf), rules(spark, sf), approvers(spark, sf))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return triggers.approval_gate(fired(spark, sf), comments(spark, sf), approvers(spark, sf), rules(spark, sf))


@query(
    "watch_pull_request_updates",
    WITH_UPDATES
    + """ SELECT watch, repo, number, epoch_us(poll_ts) AS poll_us, oid, comment_id, epoch_us(mark) AS mark_us, epoch_us(last_updated) AS updated_us,
    new_commit, new_comment FROM updates""",
)
def pull_request_updates(spark, sf):
    return shown_updates(updates(spark, sf))


def shown_updates(found: DataFrame) -> DataFrame:
    return found.select(
        "watch",
        "repo",
        "number",
        F.unix_micros("poll_ts").alias("poll_us"),
        "oid",
        "comment_id",
        F.unix_micros("mark").alias("mark_us"),
        F.unix_micros("last_updated").alias("updated_us"),
        "new_commit",
        "new_comment",
    )


@query(
    "watch_pull_request_triggers",
    f"{WITH_UPDATES}, {FIRED_SQL} SELECT watch, repo, number, epoch_us(poll_ts) AS poll_us, trigger FROM fired",
)
def pull_request_triggers(spark, sf):
    return fired(spark, sf).select("watch", "repo", "number", F.unix_micros("poll_ts").alias("poll_us"), "trigger")


@query(
    "watch_approval_gate",
    f"""{WITH_UPDATES}, {FIRED_SQL}, {COMMENTS_SQL}
    SELECT watch, repo, number, epoch_us(poll_ts) AS poll_us, trigger, approved_by, approval_body FROM gated""",
)
def approval_gate(spark, sf):
    return gated(spark, sf).select(
        "watch", "repo", "number", F.unix_micros("poll_ts").alias("poll_us"), "trigger", "approved_by", "approval_body"
    )


@query("watch_approvers", f"WITH {RULES_SQL} SELECT watch, login FROM approvers")
def approvers_by_repo(spark, sf):
    return approvers(spark, sf)


# Branches: every order priority is a branch of its customer's repository.


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per branch and poll (month): its newest order is the head."""
    orders = table(spark, sf, "orders")
    state = F.struct(
        F.concat(F.lit("o"), "o_orderkey").alias("oid"),
        F.col("o_orderdate").alias("committed_at"),
        F.when(F.col("o_orderstatus") == "P", "docs, skip ci").otherwise("change").alias("message"),
        F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("author_login"),
    )
    per_poll = orders.groupBy(
        F.date_trunc("month", F.col("o_orderdate")).alias("poll_ts"),
        F.concat(F.lit("org/r"), F.col("o_custkey") % 25).alias("repo"),
        F.col("o_orderpriority").alias("name"),
    ).agg(F.max_by(state, F.struct("o_orderdate", "o_orderkey")).alias("s"))
    return per_poll.select("poll_ts", "repo", "name", "s.*")


BRANCHES_SQL = """
heads AS (
  SELECT date_trunc('month', o_orderdate) AS poll_ts, 'org/r' || (o_custkey % 25) AS repo, o_orderpriority AS name,
    'o' || o_orderkey AS oid, o_orderdate AS committed_at,
    CASE WHEN o_orderstatus = 'P' THEN 'docs, skip ci' ELSE 'change' END AS message, 'u' || (o_custkey % 7) AS author_login
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_custkey % 25, o_orderpriority
    ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
watched AS (SELECT h.*, r.watch FROM heads h JOIN rules r USING (repo)),
newest AS (SELECT watch, poll_ts, max(committed_at) AS newest FROM watched GROUP BY ALL),
marks AS (
  SELECT watch, poll_ts, greatest(TIMESTAMP '1995-06-01', coalesce(max(newest) OVER (
    PARTITION BY watch ORDER BY poll_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1995-06-01')) AS mark FROM newest),
fresh AS (SELECT h.*, mark FROM watched h JOIN marks USING (watch, poll_ts) WHERE committed_at > mark),
changed AS (
  SELECT * FROM (SELECT *, lag(oid) OVER (PARTITION BY watch, name ORDER BY poll_ts) AS prev_oid FROM fresh)
  WHERE prev_oid IS NULL OR prev_oid <> oid)
"""


def branch_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.branch_updates(heads(spark, sf), F.lit("1995-06-01").cast("timestamp"), rules(spark, sf))


@query(
    "watch_branch_updates",
    f"WITH {RULES_SQL}, {BRANCHES_SQL} SELECT watch, repo, name, oid, epoch_us(poll_ts) AS poll_us, epoch_us(mark) AS mark_us FROM changed",
)
def branch_updates(spark, sf):
    return shown_branches(branch_changes(spark, sf))


def shown_branches(found: DataFrame) -> DataFrame:
    return found.select(
        "watch", "repo", "name", "oid", F.unix_micros("poll_ts").alias("poll_us"), F.unix_micros("mark").alias("mark_us")
    )


@query(
    "watch_branch_triggers",
    f"WITH {RULES_SQL}, {BRANCHES_SQL} SELECT watch, repo, name, oid FROM changed WHERE NOT regexp_matches(message, '.*skip ci.*')",
)
def branch_triggers(spark, sf):
    return triggers.branch_triggers(branch_changes(spark, sf), rules(spark, sf)).select("watch", "repo", "name", "oid")


@query(
    "watch_branch_approval_gate",
    f"""WITH {RULES_SQL}, {BRANCHES_SQL}
    SELECT c.watch, c.repo, c.name, c.oid, c.author_login FROM changed c JOIN rules r USING (watch)
    WHERE NOT regexp_matches(c.message, '.*skip ci.*') AND (NOT r.approval_required
      OR EXISTS (SELECT 1 FROM approvers a WHERE a.watch = c.watch AND a.login = c.author_login))""",
)
def branch_approval_gate(spark, sf):
    fired_branches = triggers.branch_triggers(branch_changes(spark, sf), rules(spark, sf))
    return triggers.branch_approval_gate(fired_branches, approvers(spark, sf), rules(spark, sf)).select("watch", "repo", "name", "oid", "author_login")


# Open pull requests: orders are pull requests, line items their commits, and
# events with an even id their comments.


def _prs(spark, sf):
    orders = table(spark, sf, "orders")
    prs = orders.select(
        F.lit("org/r").alias("repo"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("state")
    )
    items = table(spark, sf, "lineitem")
    commits = items.select(
        F.lit("org/r").alias("repo"),
        F.col("l_orderkey").alias("number"),
        F.concat_ws("-", F.lit("c"), "l_linenumber", "l_partkey", "l_suppkey").alias("oid"),
        F.col("l_shipdate").alias("committed_at"),
    )
    ev = table(spark, sf, "events")
    notes = ev.select(
        F.lit("org/r").alias("repo"),
        F.col("user_id").alias("number"),
        F.concat(F.lit("m"), "event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("body"),
    )
    return prs, commits, notes


@query(
    "watch_open_prs_with_latest",
    """WITH c AS (
      SELECT l_orderkey AS number, concat_ws('-', 'c', l_linenumber, l_partkey, l_suppkey) AS oid, l_shipdate AS committed_at FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, concat_ws('-', 'c', l_linenumber, l_partkey, l_suppkey) DESC) = 1),
    m AS (
      SELECT user_id AS number, 'm' || event_id AS id, event_type AS body FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'm' || event_id DESC) = 1)
    SELECT o_orderkey AS number, c.oid, epoch_us(c.committed_at) AS committed_us, m.id AS comment_id, m.body AS comment_body
    FROM orders LEFT JOIN c ON c.number = o_orderkey LEFT JOIN m ON m.number = o_orderkey WHERE o_orderstatus = 'O'""",
)
def open_prs_with_latest(spark, sf):
    prs, commits, notes = _prs(spark, sf)
    return changes.open_prs_with_latest(prs, commits, notes).select(
        "number",
        F.col("last_commit.oid").alias("oid"),
        F.unix_micros("last_commit.committed_at").alias("committed_us"),
        F.col("last_comment.id").alias("comment_id"),
        F.col("last_comment.body").alias("comment_body"),
    )


@query(
    "watch_branch_heads_touching",
    """WITH commits AS (
      SELECT 'org/r' || (l_suppkey % 25) AS repo, 'b' || l_partkey AS ref, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS oid,
        l_shipdate AS committed_at, l_returnflag = 'A' AS touches FROM lineitem),
    head AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo, ref ORDER BY committed_at DESC, oid DESC) = 1),
    newest AS (SELECT * FROM commits WHERE touches QUALIFY row_number() OVER (PARTITION BY repo, ref ORDER BY committed_at DESC, oid DESC) = 1)
    SELECT h.repo, h.ref, h.oid FROM head h JOIN newest n ON n.repo = h.repo AND n.ref = h.ref AND n.oid = h.oid""",
)
def branch_heads_touching(spark, sf):
    items = table(spark, sf, "lineitem")
    commits = items.select(
        F.concat(F.lit("org/r"), F.col("l_suppkey") % 25).alias("repo"),
        F.concat(F.lit("b"), "l_partkey").alias("ref"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("oid"),
        F.col("l_shipdate").alias("committed_at"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("docs/a.md"), F.concat(F.lit("src/"), "l_partkey")))
        .otherwise(F.array(F.lit("docs/a.md"), F.lit("srcs/x")))
        .alias("files"),
    )
    newest = commits.groupBy("repo", "ref").agg(F.max_by("oid", F.struct("committed_at", "oid")).alias("oid"))
    return changes.branch_heads_touching(newest, commits, "src")


@query(
    "watch_modified_files",
    """SELECT 'org/r' AS repo, o_orderkey AS number, unnest(['src/' || o_custkey, 'docs/' || o_orderpriority]) AS file FROM orders""",
)
def modified_files(spark, sf):
    orders = table(spark, sf, "orders")
    files = F.array(F.concat(F.lit("src/"), "o_custkey"), F.concat(F.lit("docs/"), "o_orderpriority"))
    return changes.modified_files(orders.select(F.lit("org/r").alias("repo"), F.col("o_orderkey").alias("number"), files.alias("files")))


@query(
    "watch_poll_snapshots",
    """WITH bounds AS (SELECT TIMESTAMP '2024-01-03 00:00:00' AS s),
    ticks AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03 12:00:00', TIMESTAMP '2024-01-25 00:00:00', INTERVAL 12 HOURS)) AS poll_ts),
    versions AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
    SELECT user_id, event_id, event_type, epoch_us(poll_ts) AS poll_us FROM versions JOIN ticks
      ON poll_ts >= ts AND (valid_to IS NULL OR poll_ts < valid_to)""",
)
def poll_snapshots(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    begin, end = F.lit("2024-01-03 00:00:00").cast("timestamp"), F.lit("2024-01-25 00:00:00").cast("timestamp")
    seen = changes.poll_snapshots(ev, ["user_id"], "ts", begin, end, 12 * 3600)
    return seen.select("user_id", "event_id", "event_type", F.unix_micros("poll_ts").alias("poll_us"))


@query(
    "watch_since_high_water",
    """WITH marks AS (SELECT user_id, median_ts AS mark FROM (SELECT user_id, max(ts) AS median_ts FROM events WHERE event_type = 'error' GROUP BY 1))
    SELECT e.user_id, e.event_id FROM events e LEFT JOIN marks m USING (user_id) WHERE m.mark IS NULL OR e.ts > m.mark""",
)
def since_high_water(spark, sf):
    ev = table(spark, sf, "events")
    marks = ev.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return changes.since_high_water(ev, marks, ["user_id"], "ts").select("user_id", "event_id")


@query(
    "watch_raise_marks",
    """SELECT user_id, epoch_us(max(ts)) AS mark_us FROM events WHERE event_type IN ('error', 'view') GROUP BY 1""",
)
def raise_marks(spark, sf):
    ev = table(spark, sf, "events")
    marks = ev.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.max("ts").alias("mark"))
    raised = changes.raise_marks(marks, ev.filter(F.col("event_type") == "view"), ["user_id"], "ts")
    return raised.select("user_id", F.unix_micros("mark").alias("mark_us"))


@query(
    "watch_matches_branch",
    """SELECT o_orderpriority AS ref, o_orderstatus AS pattern, count(*) AS n FROM orders
    WHERE regexp_matches(o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '^[12]-' ELSE 'E' END) GROUP BY ALL""",
)
def branch_patterns(spark, sf):
    orders = table(spark, sf, "orders")
    pattern = F.when(F.col("o_orderstatus") == "F", "^[12]-").otherwise("E")
    kept = orders.filter(matches_branch(F.col("o_orderpriority"), pattern))
    return kept.groupBy(F.col("o_orderpriority").alias("ref"), F.col("o_orderstatus").alias("pattern")).agg(F.count("*").alias("n"))


@query(
    "flow_poll_to_status",
    f"""{WITH_UPDATES}, {FIRED_SQL}, {COMMENTS_SQL},
    started AS (
      SELECT *, CAST(epoch_us(poll_ts) AS BIGINT) AS at_us, 'g' || (number % 2) AS grp, number % 11 = 0 AS fails,
        watch || '@' || number || '@' || epoch_us(poll_ts) AS event_id FROM gated),
    procs AS (SELECT unnest(['g0', 'g1', 'g1']) AS grp, unnest(['build', 'test', 'lint']) AS process),
    run AS (
      SELECT left(sha256(event_id || chr(31) || process), 8) AS run_id, process, repo, oid, at_us, fails FROM started JOIN procs USING (grp)),
    statuses AS (
      SELECT repo, oid AS commit, process AS context, 'pending' AS state, '' AS description, at_us AS us, run_id, 1 AS status_no FROM run
      UNION ALL
      SELECT repo, oid, process, CASE WHEN fails THEN 'failure' ELSE 'success' END,
        CASE WHEN fails THEN 'step failed' ELSE 'CI executed successfully' END, at_us + 60000000, run_id, 2 FROM run)
    SELECT repo, commit, context, state, description, us FROM statuses
    QUALIFY row_number() OVER (PARTITION BY repo, commit, context ORDER BY us DESC, run_id DESC, status_no DESC) = 1""",
)
def poll_to_status(spark, sf):
    """Polls, changes, triggers, approval, delivery, runs, statuses, latest."""
    events = gated(spark, sf).select(
        F.concat_ws("@", "watch", "number", F.unix_micros("poll_ts")).alias("event_id"),
        F.concat(F.lit("g"), F.col("number") % 2).alias("group_id"),
        F.lit(False).alias("is_exit"),
        F.col("poll_ts").alias("created_at"),
        "repo",
        F.col("oid").alias("commit"),
        F.when(F.col("number") % 11 == 0, "step failed").alias("error"),
    )
    processes = spark.createDataFrame([("g0", "build"), ("g1", "test"), ("g1", "lint")], "group_id string, name string")
    delivered = routing.broadcast_events(events, processes).withColumns(
        {
            "run_id": short_id(F.col("event_id"), F.col("process")),
            "started_at": F.col("created_at"),
            "ended_at": F.col("created_at") + F.expr("INTERVAL 1 MINUTE"),
        }
    )
    statuses = outcomes.status_lifecycle(delivered).withColumn("tie", F.struct("run_id", "status_no"))
    newest = outcomes.latest_status(statuses.withColumn("description", F.nullif("description", F.lit(""))), tie="tie")
    text = F.when(F.col("state") == "pending", "").otherwise(F.col("description"))
    return newest.select("repo", "commit", "context", "state", text.alias("description"), F.unix_micros("ts").alias("us"))

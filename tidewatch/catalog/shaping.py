"""Logs, transfers, settings, scopes, row rules and helpers on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.catalog.registry import query, table
from tidewatch.functions import text as X
from tidewatch.functions.user import define_function, host_function
from tidewatch.operators import checks, logs, settings, transfers
from tidewatch.session import send_by_value

TRIM_SQL = r"regexp_replace({}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"


def flat(labels: str) -> Column:
    """A map as text, keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ",")


# --- logs


@query(
    "log_lines",
    f"""WITH l AS (SELECT doc_id, list_filter([{TRIM_SQL.format('x')} FOR x IN string_split(text, chr(10))], lambda y: y <> '') AS ls FROM documents)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM l, LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i) t""",
)
def log_lines(spark, sf):
    return logs.log_lines(table(spark, sf, "documents"), keep=["doc_id"])


def entries(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    kind = F.col("event_type")
    level = F.when(kind == "view", "debug").when(kind == "click", "info").when(kind == "signup", "warning").when(kind == "purchase", "trace").otherwise("error")
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("r"), "user_id").alias("run_id"),
        level.alias("level"),
        F.concat(F.lit("event "), "event_id").alias("message"),
        F.when(kind == "error", F.concat(F.lit("code "), F.floor("value"))).alias("error"),
        F.when(kind == "click", F.create_map(F.lit("proc"), F.lit("own"), F.lit("k"), F.col("props"))).alias("fields"),
    )


LEVEL_SQL = "CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'trace' ELSE 'error' END"


def log_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.concat(F.lit("r"), "c_custkey").alias("run_id"),
        F.col("c_mktsegment").alias("process"),
        F.concat(F.lit("0123456789abcdef"), "c_custkey").alias("commit"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("pr"),
        F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("b"), "c_nationkey")).alias("branch"),
    )


ENRICHED_SQL = """
enriched AS (SELECT e.*, c_custkey, concat_ws(',', CASE WHEN c_nationkey % 2 = 1 THEN 'branch=b' || c_nationkey END,
    CASE WHEN c_custkey IS NOT NULL THEN 'commit=012345678' END, CASE WHEN c_custkey IS NOT NULL THEN 'id=r' || user_id END,
    CASE WHEN event_type = 'click' THEN 'k=' || props END, CASE WHEN c_nationkey % 2 = 0 THEN 'pr=' || c_nationkey END,
    CASE WHEN event_type = 'click' THEN 'proc=own' WHEN c_custkey IS NOT NULL THEN 'proc=' || c_mktsegment END) AS labels
  FROM events e LEFT JOIN customer ON c_custkey = user_id)
"""


@query("log_enrich", f"WITH {ENRICHED_SQL} SELECT event_id, labels FROM enriched")
def enrich(spark, sf):
    return logs.enrich_logs(entries(spark, sf), log_runs(spark, sf)).select("event_id", flat("fields").alias("labels"))


@query(
    "log_entries",
    f"""WITH {ENRICHED_SQL} SELECT epoch_us(ts) AS ts_us, CASE event_type WHEN 'view' THEN 'Debug' WHEN 'purchase' THEN 'Debug' WHEN 'click' THEN 'Info' WHEN 'signup' THEN 'Warning' ELSE 'Error' END AS severity,
      labels, 'event ' || event_id || CASE WHEN event_type = 'error' THEN ' code ' || CAST(floor(value) AS BIGINT) ELSE '' END AS payload FROM enriched""",
)
def log_entries(spark, sf):
    found = logs.to_log_entries(logs.enrich_logs(entries(spark, sf), log_runs(spark, sf)))
    return found.select(F.unix_micros("ts").alias("ts_us"), "severity", flat("labels").alias("labels"), "payload")


@query("log_level_filter", f"SELECT event_id, {LEVEL_SQL} AS level FROM events WHERE event_type IN ('click', 'signup', 'error')")
def level_filter(spark, sf):
    return logs.log_level_filter(entries(spark, sf)).select("event_id", "level")


@query(
    "log_of_run",
    """SELECT event_id, 'https://console.cloud.google.com/logs/viewer?advancedFilter=labels.id%3Dr7&interval=P1D' AS url FROM events JOIN customer ON c_custkey = user_id
    WHERE user_id = 7 AND ts > TIMESTAMP '2024-01-14 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'""",
)
def of_run(spark, sf):
    enriched = logs.enrich_logs(entries(spark, sf), log_runs(spark, sf)).withColumnRenamed("fields", "labels")
    found = logs.logs_of_run(enriched, "r7", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return found.select("event_id", logs.logs_url(F.col("run_id")).alias("url"))


@query(
    "log_render_message",
    """SELECT event_id, 'event ' || event_type || ' of user-' || lpad(CAST(user_id AS VARCHAR), 4, ' ') || ' cost ' ||
      CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE 'no price for ' || event_type END AS text FROM events""",
)
def render(spark, sf):
    ev = table(spark, sf, "events")
    price = F.when(F.col("event_type") == "purchase", F.floor("value"))
    none = F.lit("")
    rendered = logs.render_message(
        "event %s of user-%4s cost %s", [F.col("event_type"), F.col("user_id"), price], [none, none, F.concat(F.lit("no price for "), "event_type")]
    )
    return ev.select("event_id", rendered.alias("text"))


@query(
    "log_classify_errors",
    """WITH e AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cluster' WHEN 'O' THEN 'store' ELSE 'stream' END AS source, o_custkey % 5 AS n FROM orders)
    SELECT o_orderkey, CASE
      WHEN source = 'cluster' THEN ['ALREADY_EXISTS', 'UNCHANGED', 'NOT_FOUND', 'ACCESS_DENIED', 'UNCHANGED'][n + 1]
      WHEN source = 'store' THEN ['NOT_FOUND', 'ALREADY_EXISTS', 'BAD_PARAMETER', 'NOT_FOUND', 'UNCHANGED'][n + 1]
      ELSE ['STREAM_CLOSED', 'UNCHANGED', 'STREAM_CLOSED', 'UNCHANGED', 'STREAM_CLOSED'][n + 1] END AS error_class FROM e""",
)
def classify(spark, sf):
    orders = table(spark, sf, "orders")
    n = (F.col("o_custkey") % 5).cast("int")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), n)
    errors = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "cluster").when(F.col("o_orderstatus") == "O", "store").otherwise("stream").alias("source"),
        pick(409, 409, 404, 403, 500).alias("http_code"),
        pick("AlreadyExists", "Conflict", "", "", "").alias("reason"),
        pick("NoSuchKey", "BucketAlreadyOwnedByYou", "SlowDown", "NotFound", "").alias("code"),
        F.when(F.col("o_orderstatus") == "P", pick("http: read on response body closed", "reset", "EOF", "closed response body", "response body closed"))
        .otherwise("failed")
        .alias("message"),
    )
    return logs.classify_errors(errors).select("o_orderkey", "error_class")


# --- transfers


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", r"://([^/?#]+)", 1).alias("bucket"),
        F.regexp_extract("url", r"://[^/?#]+/*([^?#]*)", 1).alias("key"),
        F.length("html").cast("long").alias("length"),
    )


PAGES_SQL = r"""
listing AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS bucket, regexp_extract(url, '://[^/?#]+/*([^?#]*)', 1) AS key, CAST(length(html) AS BIGINT) AS length FROM pages),
cleaned AS (SELECT *, rtrim(regexp_replace(key, '/+', '/', 'g'), '/') AS path FROM listing)
"""


@query(
    "transfer_upload_plan",
    f"WITH {PAGES_SQL} SELECT CASE WHEN path = '' THEN '/srv/site' ELSE '/srv/site/' || path END AS src, CASE WHEN path = '' THEN 's3://backup/daily' ELSE 's3://backup/daily/' || path END AS dest, length FROM cleaned",
)
def upload_plan(spark, sf):
    listing = pages(spark, sf).select(F.lit("/srv/site/").alias("root"), F.col("key").alias("rel_path"), "length", F.lit(True).alias("is_dir_root"))
    return transfers.upload_plan(listing, "backup", "daily//").drop("error")


@query(
    "transfer_download_plan",
    f"WITH {PAGES_SQL} SELECT 's3://' || bucket || '/' || key AS src, CASE WHEN path = '' THEN '/srv/in' ELSE '/srv/in/' || path END AS dest, length FROM cleaned WHERE starts_with(key, 'en/')",
)
def download_plan(spark, sf):
    return transfers.download_plan(pages(spark, sf), "/srv/in", prefix="en/").drop("error")


@query(
    "transfer_parse_records",
    """WITH l AS (SELECT o_orderkey, o_custkey % 10 AS n FROM orders)
    SELECT o_orderkey, ['C', 'D', 'T', 'E', 'C', 'C', 'C', chr(1), 'Q', 'T'][n + 1] AS record, CAST([420, 493, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL][n + 1] AS BIGINT) AS mode,
      CASE n WHEN 0 THEN o_orderkey WHEN 1 THEN 0 END AS length, CASE n WHEN 0 THEN 'my file ' || o_orderkey WHEN 1 THEN 'dir' END AS name,
      CASE WHEN n = 2 THEN 1183832947000005 END AS mtime_us, CASE WHEN n = 2 THEN (1183833773 + o_orderkey) * 1000000 END AS atime_us,
      [NULL, NULL, NULL, NULL, 'invalid mode', 'invalid name', 'broken command', 'disk full', 'got unrecognized command: Q', 'invalid time'][n + 1] AS error FROM l""",
)
def parse_records(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    lines = F.array(
        F.concat(F.lit("C0644 "), key, F.lit(" my file "), key),
        F.lit("D0755 0 dir"),
        F.concat(F.lit("T1183832947 5999 "), (F.col("o_orderkey") + 1183833773).cast("string"), F.lit(" 0")),
        F.lit("E"),
        F.lit("C0999 1 x"),
        F.lit("C0644 5 .."),
        F.lit("C0644 5"),
        F.lit("\x01disk full"),
        F.lit("Q1"),
        F.lit("T1 2 x 4"),
    )
    records = transfers.parse_transfer_records(orders.select("o_orderkey", F.get(lines, (F.col("o_custkey") % 10).cast("int")).alias("line")))
    return records.select(
        "o_orderkey", "record", "mode", F.col("length").cast("long").alias("length"), "name", F.unix_micros("mtime").alias("mtime_us"), F.unix_micros("atime").alias("atime_us"), "error"
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a session: returned lines leave a directory, odd ones open one."""
    items = table(spark, sf, "lineitem")
    record = F.when(F.col("l_returnflag") == "R", "E").when(F.col("l_linenumber") % 2 == 1, "D").otherwise("C")
    long = lambda c: F.col(c).cast("long")
    return items.select(
        F.col("l_orderkey").alias("session"),
        (((long("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100 + long("l_quantity")).alias("seq_no"),
        record.alias("record"),
        F.col("l_partkey").alias("length"),
        F.concat(F.lower(record), "l_partkey").alias("name"),
        F.when(F.col("l_quantity") == 50, "disk full").alias("error"),
    )


MANIFEST_SQL = """
numbered AS (
  SELECT l_orderkey AS session, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq_no, l_partkey AS length, l_quantity = 50 AS failed,
    CASE WHEN l_returnflag = 'R' THEN 'E' WHEN l_linenumber % 2 = 1 THEN 'D' ELSE 'C' END AS record FROM lineitem),
ordered AS (SELECT *, CASE record WHEN 'D' THEN 'd' ELSE 'c' END || length AS name, row_number() OVER (PARTITION BY session ORDER BY seq_no) AS n FROM numbered),
walk AS (
  SELECT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq_no, '' AS record, '' AS name, CAST(0 AS BIGINT) AS length, ['.'] AS inside, ['.'] AS stack, false AS finished
  FROM (SELECT DISTINCT session FROM ordered)
  UNION ALL
  SELECT o.session, o.n, o.seq_no, o.record, o.name, o.length, w.stack,
    CASE WHEN o.record = 'D' THEN list_append(w.stack, o.name) WHEN o.record = 'E' AND len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END,
    w.finished OR (o.record = 'E' AND len(w.stack) = 0)
  FROM walk w JOIN ordered o ON o.session = w.session AND o.n = w.n + 1
  WHERE NOT o.failed AND NOT (o.record = 'E' AND w.finished)),
manifest AS (
  SELECT session, seq_no, record, length, '/up' || list_aggregate([''] || list_filter(inside, lambda x: x <> '.'), 'string_agg', '/') AS parent, name FROM walk WHERE record IN ('C', 'D'))
"""


@query("transfer_manifest", f"WITH RECURSIVE {MANIFEST_SQL} SELECT session, seq_no, record, parent || '/' || name AS path, parent FROM manifest")
def manifest(spark, sf):
    return transfers.transfer_manifest(records(spark, sf), "/up").drop("length")


@query("transfer_directory_bytes", f"WITH RECURSIVE {MANIFEST_SQL} SELECT session, parent AS dir, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes FROM manifest WHERE record = 'C' GROUP BY ALL")
def directory_bytes(spark, sf):
    return transfers.directory_bytes(transfers.transfer_manifest(records(spark, sf), "/up"))


# --- scopes and settings


def scopes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions enclose nations, nations enclose customers."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    tree = (
        region.select(tag("r", "r_regionkey").alias("scope_id"), F.lit(None).cast("string").alias("parent_id"))
        .unionByName(nation.select(tag("n", "n_nationkey").alias("scope_id"), tag("r", "n_regionkey").alias("parent_id")))
        .unionByName(customer.select(tag("c", "c_custkey").alias("scope_id"), tag("n", "c_nationkey").alias("parent_id")))
    )

    def owned(df: DataFrame, scope: Column, name: str, value: Column) -> DataFrame:
        return df.select(scope.alias("scope_id"), F.lit(name).alias("name"), value.alias("value"))

    values = (
        owned(region, tag("r", "r_regionkey"), "tier", F.col("r_name"))
        .unionByName(owned(region.filter("r_name = 'ASIA'"), tag("r", "r_regionkey"), "east", F.lit("yes")))
        .unionByName(owned(nation.filter("n_nationkey > 11"), tag("n", "n_nationkey"), "tier", F.col("n_name")))
        .unionByName(owned(customer.filter("c_mktsegment = 'BUILDING'"), tag("c", "c_custkey"), "tier", F.col("c_name")))
    )
    return tree, values


SCOPES_SQL = """
up AS (
  SELECT 'c' || c_custkey AS scope_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS own, n_nationkey, n_name, r_name, 0 AS lvl FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || n_nationkey, NULL, n_nationkey, n_name, r_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'r' || r_regionkey, NULL, NULL, NULL, r_name, 2 FROM region),
resolved AS (
  SELECT scope_id, 'tier' AS name, coalesce(own, CASE WHEN n_nationkey > 11 THEN n_name END, r_name) AS value,
    CASE WHEN own IS NOT NULL THEN 0 WHEN n_nationkey > 11 THEN 1 - lvl ELSE 2 - lvl END AS depth FROM up
  UNION ALL SELECT scope_id, 'east', 'yes', 2 - lvl FROM up WHERE r_name = 'ASIA')
"""


@query("scope_resolve", f"WITH {SCOPES_SQL} SELECT scope_id, name, value, depth, 'OK' AS status FROM resolved")
def resolve(spark, sf):
    return settings.resolve_scoped(*scopes(spark, sf))


@query(
    "scope_resolve_requests",
    f"""WITH {SCOPES_SQL} SELECT 'c' || c_custkey AS scope_id, q.name, r.value, r.depth, CASE WHEN r.scope_id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
    FROM customer CROSS JOIN (SELECT unnest(['east', 'west']) AS name) q LEFT JOIN resolved r ON r.scope_id = 'c' || c_custkey AND r.name = q.name""",
)
def resolve_requests(spark, sf):
    tree, values = scopes(spark, sf)
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("scope_id"), F.explode(F.array(F.lit("east"), F.lit("west"))).alias("name"))
    return settings.resolve_scoped(tree, values, wanted)


@query(
    "scope_visible_names",
    """WITH own AS (
      SELECT 'r' || r_regionkey AS s, 'tier' AS name FROM region UNION ALL SELECT 'r' || r_regionkey, 'east' FROM region WHERE r_name = 'ASIA'
      UNION ALL SELECT 'n' || n_nationkey, 'tier' FROM nation WHERE n_nationkey > 11 UNION ALL SELECT 'c' || c_custkey, 'tier' FROM customer WHERE c_mktsegment = 'BUILDING'),
    tree AS (SELECT 'r' || r_regionkey AS s, CAST(NULL AS VARCHAR) AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
    SELECT s AS scope_id, name FROM own UNION ALL SELECT t.s, 'p(' || name || ')' FROM tree t JOIN own o ON o.s = t.p
    UNION ALL SELECT t.s, 'p(p(' || name || '))' FROM tree t JOIN tree u ON u.s = t.p JOIN own o ON o.s = u.p""",
)
def visible(spark, sf):
    return settings.visible_names(*scopes(spark, sf))


@query("scope_duplicate_definitions", "SELECT 's' || o_custkey AS scope_id, o_orderpriority AS name, count(*) AS n_definitions FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, sf):
    orders = table(spark, sf, "orders")
    return settings.duplicate_definitions(orders.select(F.concat(F.lit("s"), "o_custkey").alias("scope_id"), F.col("o_orderpriority").alias("name")))


TARGET = T.StructType(
    [T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.LongType()), T.StructField("urgent", T.BooleanType()), T.StructField("note", T.StringType())]
)


def _loose(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") == "F", "n/a").when(F.col("o_orderstatus") == "O", F.floor("o_totalprice").cast("string"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "true").when(F.col("o_orderpriority") == "2-HIGH", "perhaps").otherwise("false")
    return orders.select(F.col("o_orderkey").cast("string"), price.alias("price"), urgent.alias("urgent"))


@query(
    "settings_conform",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS price, o_orderpriority = '1-URGENT' AS urgent, '' AS note
    FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '2-HIGH'""",
)
def conform(spark, sf):
    rows, _ = settings.conform(_loose(spark, sf), TARGET)
    return rows


@query(
    "settings_conform_errors",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'price' AS field, 'cannot convert to bigint' AS problem FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'urgent', 'cannot convert to boolean' FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def conform_errors(spark, sf):
    _, errors = settings.conform(_loose(spark, sf), TARGET)
    return errors.select("o_orderkey", "field", "problem")


@query(
    "settings_fill_struct_and_path",
    """SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey > 12 THEN c_mktsegment ELSE '' END AS segment, CAST(0 AS BIGINT) AS port, false AS active FROM customer""",
)
def fill(spark, sf):
    customer = table(spark, sf, "customer")
    partial = customer.select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")).alias("segment")).alias("inner")).alias("given")
    )
    full = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("inner", T.StructType([T.StructField("segment", T.StringType()), T.StructField("port", T.LongType())])),
            T.StructField("active", T.BooleanType()),
        ]
    )
    filled = partial.withColumn("full", settings.fill_struct(F.col("given"), partial.schema["given"].dataType, full))
    at = lambda path: settings.get_path(filled, path)
    return filled.select(
        "c_custkey", at("full.name").alias("name"), at("full.inner.segment").alias("segment"), at("full.inner.port").alias("port"), at("full.active").alias("active")
    )


@query(
    "settings_apply_defaults",
    """SELECT p_partkey, ['copy', 'git', 'log', 'image', 'other'][p_size % 5 + 1] AS kind, CASE WHEN p_size > 25 THEN 'x' WHEN p_size % 5 = 0 THEN '0640' ELSE '' END AS mode,
      CASE WHEN p_size > 25 THEN 'x' WHEN p_size % 5 = 1 THEN 'git' ELSE '' END AS user, CASE WHEN p_size > 25 THEN 'x' WHEN p_size % 5 = 2 THEN 'info' ELSE '' END AS level FROM part""",
)
def defaults(spark, sf):
    part = table(spark, sf, "part")
    kinds = F.array(*[F.lit(k) for k in ("copy", "git", "log", "image", "other")])
    given = F.when(F.col("p_size") > 25, "x").otherwise("")
    specs = part.select("p_partkey", F.get(kinds, F.col("p_size") % 5).alias("kind"), given.alias("mode"), given.alias("user"), given.alias("level"))
    return settings.apply_defaults(specs)


@query(
    "settings_image_and_git_defaults",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'src' ELSE '.' END AS context, CASE WHEN p_size % 3 = 0 THEN 'D.' || p_size WHEN p_size % 2 = 0 THEN 'src/Dockerfile' ELSE 'Dockerfile' END AS dockerfile,
      CASE WHEN p_size > 30 THEN 'me' WHEN p_size > 10 THEN 'git' ELSE '' END AS user FROM part""",
)
def image_defaults(spark, sf):
    size = F.col("p_size")
    specs = table(spark, sf, "part").select(
        "p_partkey",
        F.when(size % 2 == 0, "src").alias("context"),
        F.when(size % 3 == 0, F.concat(F.lit("D."), size)).alias("dockerfile"),
        F.when(size > 30, "me").otherwise("").alias("user"),
        F.when(size > 10, "/keys/id").alias("private_key_file"),
    )
    return settings.with_git_defaults(settings.with_image_defaults(specs)).drop("private_key_file")


# --- row rules


@query(
    "check_repo_rules",
    """WITH s AS (SELECT o_orderkey, o_orderstatus = 'P' AS no_url, o_orderpriority = '5-LOW' AS no_into, o_custkey % 3 = 0 AS h, o_custkey % 5 = 0 AS t, o_custkey % 7 = 0 AS b FROM orders)
    SELECT o_orderkey, 'url required' AS rule FROM s WHERE no_url UNION ALL SELECT o_orderkey, 'into required' FROM s WHERE no_into
    UNION ALL SELECT o_orderkey, 'one of hash, tag, branch required' FROM s WHERE NOT h AND NOT t AND NOT b
    UNION ALL SELECT o_orderkey, 'only one of hash, tag, branch' FROM s WHERE CAST(h AS INT) + CAST(t AS INT) + CAST(b AS INT) > 1""",
)
def repo_rules(spark, sf):
    key = F.col("o_custkey")
    specs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", "u").alias("url"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("d").alias("into"),
        F.when(key % 3 == 0, "h").alias("hash"),
        F.when(key % 5 == 0, "t").otherwise("").alias("tag"),
        F.when(key % 7 == 0, "b").alias("branch"),
    )
    return checks.violations(specs, checks.repo_rules()).select("o_orderkey", "rule")


@query(
    "check_status_and_watch_rules",
    """SELECT o_orderkey, 'state required' AS rule FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'state not valid' FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'repo malformed' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'repo required' FROM orders WHERE o_orderpriority = '2-HIGH'
    UNION ALL SELECT o_orderkey, 'teams required' FROM orders WHERE o_custkey % 2 = 0 AND o_orderpriority <> '3-MEDIUM'""",
)
def status_and_watch_rules(spark, sf):
    priority = F.col("o_orderpriority")
    specs = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "done").otherwise("").alias("state"),
        F.when(priority == "1-URGENT", "a/b/c").when(priority == "2-HIGH", "").otherwise("a/b").alias("repo"),
        (F.col("o_custkey") % 2 == 0).alias("approval_required"),
        F.when(priority == "3-MEDIUM", F.array(F.lit("a/t"))).alias("teams"),
    )
    return checks.violations(specs, checks.status_rules() | checks.watch_rules()).select("o_orderkey", "rule")


@query(
    "check_script_copy_log_rules",
    """WITH s AS (SELECT p_partkey, p_size % 4 AS c, p_size % 3 AS k, p_size % 5 AS o FROM part)
    SELECT p_partkey, 'command or args required' AS rule FROM s WHERE c = 0 UNION ALL SELECT p_partkey, 'only one of command, args' FROM s WHERE c = 3
    UNION ALL SELECT p_partkey, 'source not supported' FROM s WHERE k = 2 UNION ALL SELECT p_partkey, 'source and destination of one kind' FROM s WHERE k = 1
    UNION ALL SELECT p_partkey, 'output type not supported' FROM s WHERE o = 4 UNION ALL SELECT p_partkey, 'credentials required' FROM s WHERE o = 1
    UNION ALL SELECT p_partkey, 'only one of credentials, credentials_file' FROM s WHERE o = 3""",
)
def script_copy_log_rules(spark, sf):
    size = F.col("p_size")
    specs = table(spark, sf, "part").select(
        "p_partkey",
        F.when((size % 4).isin(1, 3), "ls").alias("command"),
        F.when((size % 4).isin(2, 3), F.array(F.lit("ls"))).alias("args"),
        F.when(size % 3 == 0, "local").when(size % 3 == 1, "s3").otherwise("ftp").alias("src_kind"),
        F.lit("s3").alias("dest_kind"),
        F.when(size % 5 == 0, "stdout").when(size % 5 == 4, "file").otherwise("stackdriver").alias("type"),
        F.when((size % 5).isin(2, 3), "{}").alias("credentials"),
        F.when(size % 5 == 3, "/c").alias("credentials_file"),
    )
    rules = checks.script_rules() | checks.copy_rules() | checks.log_output_rules()
    return checks.violations(specs, rules).select("p_partkey", "rule")


@query(
    "check_image_job_command_rules",
    """WITH s AS (SELECT p_partkey, p_size FROM part)
    SELECT p_partkey, 'tag required' AS rule FROM s WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'secret id required' FROM s WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'secret file required' FROM s WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, 'argument key required' FROM s WHERE p_size % 5 = 0
    UNION ALL SELECT p_partkey, 'argument value required' FROM s WHERE p_size % 5 = 1 UNION ALL SELECT p_partkey, 'container required' FROM s WHERE p_size % 7 = 0
    UNION ALL SELECT p_partkey, 'container image required' FROM s WHERE p_size % 7 = 1 UNION ALL SELECT p_partkey, 'container name required' FROM s WHERE p_size % 7 = 2
    UNION ALL SELECT p_partkey, 'field name required' FROM s WHERE p_size % 4 = 1 UNION ALL SELECT p_partkey, 'field defined twice' FROM s WHERE p_size % 4 = 2""",
)
def image_job_command_rules(spark, sf):
    size = F.col("p_size")
    pair = lambda a, x, b, y: F.struct(x.alias(a), y.alias(b))
    filled = lambda broken, value: F.when(broken, "").otherwise(value)
    field = lambda name: F.struct(name.alias("name"))
    common = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        filled(size % 2 == 0, "t").alias("tag"),
        F.array(pair("id", filled(size % 3 == 0, "i"), "file", filled(size % 3 == 1, "f"))).alias("secrets"),
        F.array(pair("key", filled(size % 5 == 0, "k"), "val", filled(size % 5 == 1, "v"))).alias("args"),
        F.when(size % 7 != 0, F.array(pair("image", filled(size % 7 == 1, "i"), "name", filled(size % 7 == 2, "n")))).alias("containers"),
        F.array(field(F.lit("a")), field(F.when(size % 4 == 1, "").when(size % 4 == 2, "a").otherwise("b"))).alias("fields"),
    )
    return checks.violations(common, checks.image_rules() | checks.job_rules() | checks.command_rules()).select("p_partkey", "rule")


# --- helpers and user functions


@query(
    "text_names",
    """SELECT c_custkey, nullif(regexp_replace(lower(c_name), '[^a-z0-9\\-.]', '', 'g'), '') AS resource, 'c' || c_custkey AS owner, c_mktsegment AS repo,
      CASE WHEN c_nationkey % 2 = 0 THEN 'root' ELSE '' END AS user, 'h' || c_nationkey || ':22' AS host, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS capitalized,
      CASE WHEN c_nationkey % 3 = 0 THEN 'reg:5000/i:v' || c_nationkey ELSE 'reg:5000/i' || ':latest' END AS image FROM customer""",
)
def names(spark, sf):
    customer = table(spark, sf, "customer")
    repo = X.split_repo(F.concat(F.lit("c"), "c_custkey", F.lit("/"), "c_mktsegment"))
    address = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "root@").otherwise(""), F.lit("h"), "c_nationkey", F.lit(":22"))
    image = F.concat(F.lit("reg:5000/i"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(":v"), "c_nationkey")).otherwise(""))
    return customer.select(
        "c_custkey",
        X.resource_name(F.col("c_name")).alias("resource"),
        repo["owner"].alias("owner"),
        repo["name"].alias("repo"),
        X.split_host(address)["user"].alias("user"),
        X.split_host(address)["host"].alias("host"),
        X.capitalize(F.lower("c_mktsegment")).alias("capitalized"),
        X.with_latest_tag(image).alias("image"),
    )


@query(
    "text_dates_and_quantities",
    """SELECT event_id, strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M') || ' UTC' AS shown,
      user_id * [1, 1000, 1000000, 1048576000, 0][event_id % 5 + 1] AS milli, left(sha256(event_id || chr(31) || event_type), 8) AS id FROM events""",
)
def dates(spark, sf):
    ev = table(spark, sf, "events")
    suffix = F.get(F.array(*[F.lit(s) for s in ("m", "", "k", "Mi", "x")]), (F.col("event_id") % 5).cast("int"))
    amount = X.quantity(F.concat("user_id", suffix))
    return ev.select(
        "event_id",
        X.human_date(F.col("ts")).alias("shown"),
        F.coalesce((amount * 1000).cast("long"), F.lit(0)).cast("long").alias("milli"),
        X.short_id(F.col("event_id"), F.col("event_type")).alias("id"),
    )


@query(
    "text_escape_control",
    """WITH spoken AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(27) || '[0m' || chr(7) || chr(160) END AS text FROM documents),
    quoted AS (SELECT doc_id, text, replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS q FROM spoken),
    shown AS (SELECT doc_id, text, replace(replace(replace(replace(replace(q, chr(7), chr(92) || 'a'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(27), chr(92) || 'x1b'), chr(160), chr(92) || 'u00a0') AS q FROM quoted)
    SELECT doc_id, md5(CASE WHEN q = replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') THEN text ELSE '"' || q || '"' END) AS digest, length(q) > length(text) AS longer FROM shown""",
)
def escape(spark, sf):
    """Whole texts, two thirds of them with control characters and a wide space added."""
    ending = F.when(F.col("doc_id") % 3 == 0, "").otherwise("\x1b[0m\x07\xa0")
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", ending).alias("text"))
    shown = docs.withColumn("shown", X.escape_control(F.col("text")))
    bare = F.when(F.col("shown") == F.col("text"), F.regexp_replace("text", r"([\\\"])", r"\\$1")).otherwise(F.substr("shown", F.lit(2), F.length("shown") - 2))
    return shown.select("doc_id", F.md5(F.col("shown").cast("binary")).alias("digest"), (F.length(bare) > F.length("text")).alias("longer"))


@query("function_defined", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big ' || o_orderstatus ELSE 'small' END AS label FROM orders")
def defined(spark, sf):
    define_function(spark, "tidewatch_label", {"price": "DOUBLE", "status": "STRING"}, "CASE WHEN price > 200000 THEN concat('big ', status) ELSE 'small' END", "STRING")
    return table(spark, sf, "orders").select("o_orderkey", F.expr("tidewatch_label(o_totalprice, o_orderstatus)").alias("label"))


def _half(key: int, status: str) -> int:
    if status == "F":
        raise ValueError(f"order {key} failed")
    return key // 2


@query("function_host", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey // 2 END AS half, CASE WHEN o_orderstatus = 'F' THEN 'order ' || o_orderkey || ' failed' END AS error FROM orders")
def host(spark, sf):
    called = host_function(_half, "bigint")(F.col("o_orderkey"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", called.alias("r")).select("o_orderkey", F.col("r.value").alias("half"), "r.error")


send_by_value(__name__)

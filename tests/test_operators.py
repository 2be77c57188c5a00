"""Transfers, settings, logs, diffs, sources and sinks on small fixtures."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import text as X
from tidewatch.functions.predicates import at_level, contains
from tidewatch.functions.user import host_function
from tidewatch.operators import checks, diffs, jobs, logs, settings, transfers
from tidewatch.sources import files, sinks
from tidewatch.sources.ticks import stream_ticks, ticker_events
from tidewatch.streaming.jobs import run_once


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# --- transfers


def walk(records, target):
    """Paths of a session, record by record."""
    stack, finished, out = ["."], False, []
    for seq, record, name, failed in records:
        if failed:
            return out
        inside = "/".join([target, *[s for s in stack if s != "."]])
        if record == "E":
            if finished:
                return out
            if stack:
                stack.pop()
            else:
                finished = True
            continue
        out.append((seq, f"{inside}/{name}", inside))
        if record == "D":
            stack.append(name)
    return out


@pytest.mark.parametrize("limit", [10**6, 30])
def test_manifest_against_a_stack(spark, limit):
    rng = random.Random(11)
    sessions = {}
    for s in range(40):
        n = 200 if s == 0 else rng.randint(1, 20)
        kinds = "DDDCCEE" if s else "DDDCCEE"
        sessions[s] = [(i, rng.choice(kinds), f"n{i}", rng.random() < (0 if s == 0 else 0.03)) for i in range(n)]
    rows = [(s, i, kind, 1, name, "bad" if failed else None) for s, records in sessions.items() for i, kind, name, failed in records]
    df = spark.createDataFrame(rows, "session int, seq_no int, record string, length long, name string, error string").repartition(4)
    got = {}
    for r in transfers.transfer_manifest(df, "/t", limit=limit).orderBy("session", "seq_no").collect():
        got.setdefault(r.session, []).append((r.seq_no, r.path, r.parent))
    assert got == {s: walk(records, "/t") for s, records in sessions.items() if walk(records, "/t")}


def test_clean_paths(spark):
    cases = {"a//b/./c/": "a/b/c", "/": "/", "": ".", "a/../b": "b", "../a": "../a", "/../a": "/a", "a/b/../../..": ".."}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.c for r in df.select("p", transfers.clean_path(F.col("p")).alias("c")).collect()} == cases


def test_transfer_times(spark):
    df = spark.createDataFrame([("T1183832947 0 1183833773 0",), ("T1 2 3",), ("D0755 0 a b c",)], "line string")
    rows = transfers.parse_transfer_records(df).collect()
    assert [r.error for r in rows] == [None, "broken mtime command", None]
    assert rows[0].mtime == datetime(2007, 7, 7, 18, 29, 7)
    assert (rows[2].mode, rows[2].name) == (0o755, "a b c")


def test_a_folder_needs_a_recursive_copy(spark):
    listing = spark.createDataFrame([("/d", "x", 1, True)], "root string, rel_path string, length long, is_dir_root boolean")
    assert transfers.upload_plan(listing, "b", "k", recursive=False).first().error == "path /d is a directory, use RecursiveCopy"
    file = spark.createDataFrame([("/d/f", "", 1, False)], "root string, rel_path string, length long, is_dir_root boolean")
    assert transfers.upload_plan(file, "b", "k").first().dest == "s3://b/k"


# --- settings


def test_conform_rejects_unknown_columns(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(ValueError):
        settings.conform(spark.createDataFrame([("1", "2")], "a string, b string"), schema)
    with pytest.raises(ValueError):
        settings.fill_struct(F.lit(None), T.StructType([T.StructField("z", T.LongType())]), schema)
    with pytest.raises(ValueError):
        settings.get_path(spark.createDataFrame([(1,)], "a int"), "a.b")


def test_a_plain_value_for_an_embedded_field(spark):
    inner = T.StructType([T.StructField("n", T.LongType(), metadata={"embedded": True}), T.StructField("unit", T.StringType())])
    rows, errors = settings.conform(spark.createDataFrame([("7",), ("x",)], "size string"), T.StructType([T.StructField("size", inner)]))
    assert [tuple(r.size) for r in rows.collect()] == [(7, "")]
    assert [(r.size, r.field) for r in errors.collect()] == [("x", "size")]


def test_scopes_shadow_and_cycle(spark):
    tree = spark.createDataFrame([("g", None), ("p", "g"), ("f", "p")], "scope_id string, parent_id string")
    values = spark.createDataFrame([("g", "x", "1"), ("p", "x", "2"), ("g", "y", "3"), ("f", "z", "4")], "scope_id string, name string, value string")
    got = {(r.scope_id, r.name): r.value for r in settings.resolve_scoped(tree, values).collect()}
    assert got == {("g", "x"): "1", ("g", "y"): "3", ("p", "x"): "2", ("p", "y"): "3", ("f", "x"): "2", ("f", "y"): "3", ("f", "z"): "4"}
    names = {(r.scope_id, r.name) for r in settings.visible_names(tree, values).collect()}
    assert {n for s, n in names if s == "f"} == {"z", "p(x)", "p(p(x))", "p(p(y))"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "scope_id string, parent_id string")
    with pytest.raises(ValueError):
        settings.scope_ancestors(loop)
    longer = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "scope_id string, parent_id string")
    with pytest.raises(ValueError):
        settings.scope_ancestors(longer)


def test_scopes_of_any_depth_and_from_requests(spark):
    chain = spark.range(40).select(F.col("id").cast("string").alias("scope_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    got = {(r.scope_id, r.ancestor_id): r.depth for r in settings.scope_ancestors(chain).collect()}
    assert got == {(str(i), str(j)): i - j for i in range(40) for j in range(i + 1)}
    some = settings.scope_ancestors(chain, spark.createDataFrame([("39", "x"), ("39", "y")], "scope_id string, name string")).collect()
    assert sorted(r.depth for r in some) == list(range(40)) and {r.scope_id for r in some} == {"39"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "scope_id string, parent_id string")
    with pytest.raises(ValueError):
        settings.resolve_scoped(loop, spark.createDataFrame([("a", "x", "1")], "scope_id string, name string, value string"))


def test_deep_scopes(spark):
    """A chain of 5,000 scopes with a second name redefined on the way, and a scope beside it;
    requests of scopes that do not exist and of names that are not defined."""
    n = 5000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up")).union(spark.createDataFrame([(9000, 17)], "id long, up long"))
    chain = chain.select(F.col("id").cast("string").alias("scope_id"), F.col("up").cast("string").alias("parent_id"))
    values = spark.createDataFrame(
        [("0", "x", "top"), ("0", "y", "a"), ("3000", "y", "b"), ("20", "z", "c"), ("7777", "x", "own")], "scope_id string, name string, value string"
    )
    wanted = [("4999", "x", "top", 4999), ("4999", "y", "b", 1999), ("2999", "y", "a", 2999), ("9000", "x", "top", 18), ("9000", "z", None, None), ("7777", "x", "own", 0), ("5", "q", None, None)]
    asked = spark.createDataFrame([(s, name) for s, name, *_ in wanted], "scope_id string, name string")
    got = settings.resolve_scoped(chain, values, asked).collect()
    assert sorted((r.scope_id, r.name, r.value or "", r.depth or 0) for r in got) == sorted((s, k, v or "", d or 0) for s, k, v, d in wanted)
    assert {r.name for r in got if r.status == "NOT_FOUND"} == {"z", "q"}


def test_null_keys_match(spark):
    schema = "kind string, namespace string, cluster_ip string, v int"
    current = spark.createDataFrame([("Job", None, "x", 1), ("Service", None, "ip", 1)], schema)
    desired = spark.createDataFrame([("Job", None, "y", 2), ("Service", None, None, 2)], schema)
    done = {(r.kind, r.namespace, r.cluster_ip, r.v, r.action) for r in diffs.upsert_objects(current, desired, ["kind", "namespace"], keep=("cluster_ip",)).collect()}
    assert done == {("Job", None, "y", 2, "UPDATE"), ("Service", None, "ip", 2, "UPDATE")}
    changed = diffs.snapshot_diff(current, desired, ["kind", "namespace"], ["v"]).collect()
    assert {(r.kind, r.change, r.old_v) for r in changed} == {("Job", "CHANGED", 1), ("Service", "CHANGED", 1)}


def test_hostile_transfer_lines(spark):
    lines = ["C-644 5 x", "C+644 5 x", "C0000000000000644 5 x", "C99999999999999999999 5 x", "C644 +5 x", "C644 0000000000000000000000005 x",
             "T99999999999999 0 0 0", "T99999999999999999999 0 0 0", "T1 2000 -1 -1", "T9223372036854775807 9223372036854775807 0 0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    rows = {r.i: r for r in transfers.parse_transfer_records(df).collect()}
    assert [rows[i].mode for i in range(6)] == [-420, 420, 420, None, None, 420]
    assert [rows[i].error for i in range(6)] == [None, None, None, "invalid mode", "invalid length", None]
    assert rows[5].length == 5
    assert [rows[i].error for i in range(6, 10)] == ["time out of range", "invalid time", None, "time out of range"]
    us = transfers.parse_transfer_records(df.filter("i = 8")).select(F.unix_micros("mtime"), F.unix_micros("atime")).first()
    assert tuple(us) == (1_000_002, -1_000_001)


def test_host_functions_see_plain_values(spark):
    seen = host_function(lambda n, s: f"{n!r} {s!r}", "string")
    df = spark.createDataFrame([(1, "a"), (None, None), (9007199254740993, "b")], "n long, s string").coalesce(1)
    assert [r[0] for r in df.select(seen("n", "s")["value"]).collect()] == ["1 'a'", "None None", "9007199254740993 'b'"]
    same = host_function(lambda n: n + 1, "bigint")
    got = df.select(same("n").alias("r")).select("r.value", "r.error").collect()
    assert [r.value for r in got] == [2, None, 9007199254740994] and got[1].error


# --- predicates, text, logs


def test_contains_never_null(spark):
    df = spark.createDataFrame([(["a", None], "b"), (["a", None], "a"), (None, "a"), (["a"], None)], "a array<string>, x string")
    assert [r[0] for r in df.select(contains(F.col("a"), F.col("x"))).collect()] == [False, True, False, False]


def test_levels(spark):
    df = spark.createDataFrame([(n,) for n in ("warn", "debug", "INFO", "fatal")], "l string")
    assert [r[0] for r in df.select(at_level(F.col("l"))).collect()] == [True, False, True, True]
    assert [r[0] for r in df.select(at_level(F.col("l"), "error", debug=True)).collect()] == [True, True, True, True]
    with pytest.raises(ValueError):
        at_level(F.col("l"), "loud")


def test_text_helpers(spark):
    assert one(spark, X.go_duration(F.lit(3_723_500_000))) == "1h2m3.5s"
    assert one(spark, X.go_duration(F.lit(-1500))) == "-1.5ms"
    assert one(spark, X.escape_control(F.lit("a \x1b\U0001f600"))) == '"a\\u00a0\\x1b\U0001f600"'
    assert one(spark, X.resource_name(F.lit("__"))) is None
    assert one(spark, X.split_repo(F.lit("a/b/c"))) is None
    assert one(spark, X.with_latest_tag(F.lit("a/b@sha256:0"))) == "a/b@sha256:0"
    assert one(spark, X.status_context(F.lit(""), F.lit(None))) == "ci/status"
    assert str(one(spark, X.quantity(F.lit("1e3"))).normalize()) == "1E+3"
    cases = {"300n": "3E-7", "0.5u": "5E-7", "1.5Ki": "1536", "2Ei": "2305843009213693952", "12345678901Gi": str(12345678901 * 2**30), "-7m": "-0.007", ".5": "0.5", "3E": "3E+18"}
    for text, value in cases.items():
        assert one(spark, X.quantity(F.lit(text))) == Decimal(value), text
    assert one(spark, X.quantity(F.lit("9" * 40))) is None and one(spark, X.quantity(F.lit("1e99"))) is None and one(spark, X.quantity(F.lit("9" * 30 + "Ei"))) is None


def test_error_fields_and_source(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), "panic", "m", "bad", {"error": "bad", "a": "1"}, {"a": "2", "b": "3"}, [("f.go", 7, "F")])],
        "ts timestamp, level string, message string, error string, fields map<string,string>, error_fields map<string,string>, traces array<struct<path:string,line:int,func:string>>",
    )
    row = logs.to_log_entries(df).first()
    assert (row.severity, row.labels, row.payload, tuple(row.source)) == ("Error", {"a": "2", "b": "3"}, "m bad", ("f.go", 7, "F"))


# --- diffs and jobs


def test_pods_with_unknown_state_always_differ(spark):
    schema = "namespace string, name string, phase string, containers array<struct<name:string,state:string,restarts:int,exit_code:int,started_at:timestamp,finished_at:timestamp,reason:string>>"
    pod = ("n", "p", "Running", [("c", "unknown", 0, None, None, None, None), ("d", "running", 0, None, None, None, None)])
    df = spark.createDataFrame([pod], schema)
    assert [r.name for r in diffs.container_diff(df, df).collect()] == ["c"]
    gone = spark.createDataFrame([], schema)
    assert diffs.pod_diff(df, gone).count() == 0
    assert diffs.log_streams_to_open(diffs.container_diff(gone, df), first_check=False).count() == 1


def test_labels_must_all_match(spark):
    pods = spark.createDataFrame(
        [("n", "p", {"a": "1"}, [("Job", "u")]), ("n", "q", {"a": "1", "b": "2"}, [("Job", "u"), ("Job", "u")])],
        "namespace string, name string, labels map<string,string>, owners array<struct<kind:string,uid:string>>",
    )
    job = spark.createDataFrame([("n", "j", "u", {"a": "1", "b": "2"})], "namespace string, name string, uid string, selector map<string,string>")
    assert [r.name for r in jobs.owned_pods(pods, job).collect()] == ["q"]
    assert jobs.owned_pods(pods, job.withColumn("selector", F.lit(None).cast("map<string,string>"))).count() == 2


def test_command_rules(spark):
    df = spark.createDataFrame([("", [("a",), ("a",)]), ("x", [("",)])], "name string, fields array<struct<name:string>>")
    got = sorted((r.name, r.rule) for r in checks.violations(df, checks.command_rules()).collect())
    assert got == [("", "command name required"), ("", "field defined twice"), ("x", "field name required")]


# --- sources and sinks


def test_ticks(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 25))], "start timestamp, end timestamp")
    assert [r.tick.second for r in ticker_events(df, 10).collect()] == [10, 20]
    with pytest.raises(ValueError):
        ticker_events(df, 0)
    assert stream_ticks(spark).isStreaming


def test_file_listing_opens_no_file(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "sub" / "b.txt").write_text("hi")
    found = files.file_listing(spark, f"{tmp_path}/in").orderBy("rel_path")
    assert [(r.rel_path, r.length) for r in found.collect()] == [("a.txt", 5), ("sub/b.txt", 2)]
    found.explain()
    assert "content" not in capsys.readouterr().out


def test_only_known_files_change(spark):
    schema = "path string, length long, mtime long"
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], schema)
    after = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("new", 1, 1)], schema)
    assert sorted(tuple(r) for r in files.file_changes(before, after).collect()) == [("b", "WRITE"), ("c", "REMOVE")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, 5), "Info", "m")], "ts timestamp, severity string, payload string")
    with pytest.raises(ValueError):
        sinks.write_logs(df, {"paper": None})
    with pytest.raises(ValueError):
        sinks.write_logs(df, {"stdout": None})
    many = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("payload", F.concat("payload", F.lit("\n"), "n")).drop("n")
    for _ in range(2):
        sinks.write_logs(many, {"stdout": f"{tmp_path}/out", "stackdriver": f"{tmp_path}/logs"}, batch_id=0)
    assert sorted(spark.read.schema(df.schema).json(f"{tmp_path}/logs").drop("batch_id", "stream").collect()) == sorted(many.collect())
    assert spark.read.text(f"{tmp_path}/out").count() == 50
    for stream in ("a", "a", "b"):
        sinks.write_statuses(df, f"{tmp_path}/st", 3, stream)
    assert spark.read.parquet(f"{tmp_path}/st").count() == 2
    sinks.write_statuses(df, f"{tmp_path}/st")
    assert spark.read.parquet(f"{tmp_path}/st").count() == 3


def test_an_action_per_batch(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    action = sinks.for_each_event(lambda batch, batch_id: seen.append((batch_id, batch.count())))
    run_once(stream.writeStream.foreachBatch(action).option("checkpointLocation", f"{tmp_path}/ck"))
    assert sum(n for _, n in seen) == 5

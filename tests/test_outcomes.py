"""Run outcomes: the truth table of a sequence, and the other folds."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import outcomes, routing
from tidewatch.streaming import admission, jobs
from tidewatch.streaming.admission import admission_totals, stream_admission_counts, stream_admit
from tidewatch.streaming.jobs import run_once

STEP = "run_id int, seq_no int, is_deferred boolean, error string, value string"


def run_by_hand(steps):
    value, error, executed = None, None, []
    for seq, deferred, err, val in steps:
        if deferred:
            continue
        value = val
        executed.append(seq)
        if err:
            error = err
            break
    for _, deferred, err, _ in reversed(steps):
        if deferred and err:
            error = err
    return value, error


def test_every_sequence_of_four_steps(spark):
    kinds = [(False, None), (False, "e"), (True, None), (True, "d")]
    runs, rows = {}, []
    for run, combo in enumerate(itertools.product(kinds, repeat=4)):
        steps = [(seq, deferred, err and f"{err}{seq}", f"v{seq}") for seq, (deferred, err) in enumerate(combo)]
        runs[run] = run_by_hand(steps)
        rows += [(run, *s) for s in steps]
    df = spark.createDataFrame(rows, STEP)
    got = {r.run_id: (r.value, r.error) for r in outcomes.sequence_outcome(df).collect()}
    assert got == runs
    states = outcomes.step_states(df)
    assert states.filter("state = 'failed'").groupBy("run_id").count().filter("count > 1").count() == 0


def test_a_reached_deferred_step_counts_double(spark):
    rows = [(1, 0, True, None, "a"), (1, 1, False, "boom", "b"), (1, 2, True, "late", "c")]
    row = outcomes.sequence_outcome(spark.createDataFrame(rows, STEP), count_double=True).first()
    assert (row.n_deferred_run, row.error, row.value, row.first_error_seq) == (3, "late", "b", 1)


def test_parallel_slots_fill_in_arrival_order(spark):
    rows = [(1, 0, None, "a", 30), (1, 1, "x", "b", 10), (1, 2, "y", "c", 20)]
    df = spark.createDataFrame(rows, "run_id int, branch int, error string, value string, ended_at int")
    slots = outcomes.parallel_slots(df).orderBy("slot").collect()
    assert [(r.slot, r.branch, r.value) for r in slots] == [(0, 1, ""), (1, 2, ""), (2, 0, "a")]
    row = outcomes.parallel_outcome(df).first()
    assert (row.ok, row.n_failed, row.first_error) == (False, 2, "x")


@pytest.mark.parametrize("limit", [10**6, 5])
def test_error_summary_keeps_every_error(spark, limit):
    rows = [(1, i, f"e{i}") for i in range(12)] + [(2, 1, "only"), (3, 1, "")]
    df = spark.createDataFrame(rows, "run_id int, seq_no int, error string")
    got = {(r.run_id, r.part_no): (r.n_errors, r.summary) for r in outcomes.error_summary(df, ["run_id"], ["seq_no"], part_size=11, limit=limit).collect()}
    assert got == {(1, 1): (11, ", ".join(f"e{i}" for i in range(11))), (1, 2): (1, "e11"), (2, 1): (1, "only")}
    listed = outcomes.error_rows(df, ["run_id"], ["seq_no"], limit=limit).filter("run_id = 1").orderBy("error_no").collect()
    assert [(r.error_no, r.error) for r in listed] == [(i + 1, f"e{i}") for i in range(12)]


def test_fleet_needs_hosts_and_commands(spark):
    hosts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run_id int, host string")
    commands = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "run_id int, seq_no int")
    results = spark.createDataFrame(
        [(1, "a", 1, None, "x", 1), (1, "a", 2, None, "y", 4), (1, "b", 1, "down", None, 2)],
        "run_id int, host string, seq_no int, error string, value string, ended_at int",
    )
    per_host, per_run = outcomes.fleet_outcome(hosts, commands, results)
    assert {(r.run_id, r.host): (r.value, r.error) for r in per_host.collect()} == {(1, "a"): ("y", None), (1, "b"): (None, "down"), (2, "a"): (None, None)}
    assert {r.run_id: (r.ok, r.error) for r in per_run.collect()} == {
        1: (False, "down"),
        2: (False, "provide at least one session action"),
        3: (False, "a session needs at least one host"),
    }


def test_status_of_failed_run(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("r1", "o/r", "c", "build", at, at, "boom")], "run_id string, repo string, commit string, process string, started_at timestamp, ended_at timestamp, error string")
    rows = outcomes.status_lifecycle(df).orderBy("status_no").collect()
    assert [(r.state, r.description, r.context) for r in rows] == [("pending", "", "build"), ("failure", "boom", "build")]
    texts = [r.text for r in outcomes.chat_lifecycle(df).orderBy("message_no").collect()]
    assert texts[1:] == [":collision: Action failed with boom.", ":heavy_check_mark: Action completed successfully."]


def test_exit_code(spark):
    df = spark.createDataFrame([(None, None), ("", 3), ("x", 3), ("x", None)], "error string, code int")
    assert [r[0] for r in df.select(outcomes.exit_code(F.col("error"), F.col("code"))).collect()] == [0, 0, 3, -1]


def test_until_exit_and_admit(spark):
    rows = [("g", 1, False), ("g", 2, True), ("g", 3, False), ("h", 1, False)]
    df = spark.createDataFrame(rows, "g string, n int, is_exit boolean")
    assert sorted((r.g, r.n) for r in routing.until_exit(df, ["g"], ["n"]).collect()) == [("g", 1), ("g", 2), ("h", 1)]
    events = spark.createDataFrame([(i, "k") for i in range(100)], "id int, k string").withColumn("ts", F.timestamp_seconds("id"))
    admitted, dropped = routing.admit(events, ["k"], "50 seconds", ["ts", "id"], cap=20)
    assert sorted(r.id for r in admitted.collect()) == [*range(20), *range(50, 70)]
    assert sorted(r.id for r in dropped.collect()) == [*range(20, 50), *range(70, 100)]


def test_null_groups_times_and_keys(spark):
    rows = [(None, 1, False), (None, 2, True), (None, 3, False), ("h", 1, False)]
    df = spark.createDataFrame(rows, "g string, n int, is_exit boolean")
    assert sorted((r.g or "", r.n) for r in routing.until_exit(df, ["g"], ["n"]).collect()) == [("", 1), ("", 2), ("h", 1)]
    events = spark.createDataFrame([(i, None if i % 2 else "k", None if i > 17 else i) for i in range(21)], "id int, k string, s int")
    timed = events.withColumn("ts", F.timestamp_seconds("s"))
    admitted, dropped = routing.admit(timed, ["k"], "50 seconds", ["ts", "id"], cap=3)
    assert sorted(r.id for r in admitted.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.id for r in dropped.collect()) == list(range(6, 21))
    steps = spark.createDataFrame([(None, 1, False, "bad"), (None, 2, False, None)], "run_id int, seq_no int, is_deferred boolean, error string")
    assert [(r.seq_no, r.state) for r in outcomes.step_states(steps).orderBy("seq_no").collect()] == [(1, "failed"), (2, "skipped")]


def test_process_names_are_numbered_over_all_tasks(spark):
    specs = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "named").alias("name"), F.lit("w").alias("watch"), F.lit("r").alias("run"))
    got = [r.name for r in routing.process_defaults(specs.repartition(7), "host", ["n"]).orderBy("n").collect()]
    unnamed = iter(range(1, 1000))
    assert got == ["named" if i % 3 == 0 else f"host-{next(unnamed)}" for i in range(1000)]
    plan = routing.process_defaults(specs, "host", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_fan_in_and_defaults(spark):
    with pytest.raises(ValueError):
        routing.fan_in()
    specs = spark.createDataFrame([(1, "", "", "x"), (2, "a", "t", None), (3, None, None, "y")], "n int, name string, watch string, run string")
    rows = routing.process_defaults(specs, "host", ["n"]).orderBy("n").collect()
    assert [(r.name, r.watch, r.error is None) for r in rows] == [("host-1", "oneshot", True), ("a", "t", False), ("host-2", "oneshot", True)]


def test_durations_have_a_median(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", at, datetime(2024, 1, 1, 0, 0, s), None) for s in (1, 2, 9)], "process string, started_at timestamp, ended_at timestamp, error string")
    row = routing.run_durations(df).first()
    assert (row.n_runs, row.avg_seconds, row.max_seconds, row.median_seconds) == (3, 4.0, 9.0, 2.0)


def test_streamed_admission_keeps_every_event(spark, tmp_path):
    """Counts go on between micro-batches; late, untimed and surplus events stay findable."""
    schema = "id int, k string, s int"
    batches = [
        [(i, "k", i) for i in range(10)] + [(10, None, 3), (11, None, None)],
        [(20 + i, "k", 20 + i) for i in range(5)] + [(30, "k", 400_000)],
        [(40, "k", 5), (41, "k", 400_001), (42, None, 400_002)],
    ]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(f"{schema}, ts timestamp").parquet(f"{tmp_path}/in")
        run_once(stream_admit(events, ["k"], "1 hour", ["ts", "id"], f"{tmp_path}/state", cap=12, lateness="1 day"))
        run_once(stream_admission_counts(events, ["k"], "1 hour", "ts", f"{tmp_path}/counts"))
    found = {name: spark.read.parquet(f"{tmp_path}/state/{name}").collect() for name in ("admitted", "dropped", "late")}
    assert sorted(r.id for r in found["admitted"]) == [*range(11), 20, 21, 30, 41, 42]
    assert {r.id: r.position for r in found["admitted"]}[21] == 12 and {r.id: r.position for r in found["admitted"]}[41] == 2
    assert sorted(r.id for r in found["dropped"]) == [11, 22, 23, 24]
    assert [r.id for r in found["late"]] == [40]
    totals = admission_totals(spark.read.parquet(f"{tmp_path}/counts/counts"), ["k"], 12).collect()
    assert sorted((r.k or "", r.n_admitted, r.n_dropped) for r in totals) == [("", 1, 0), ("", 1, 0), ("k", 2, 0), ("k", 12, 4)]


def test_counts_are_merged_by_levels(spark, tmp_path):
    """The number of folders stays bounded, and no count is lost or taken twice, also
    after a break between writing a merged folder and removing its parts."""
    state, rows, most = f"{tmp_path}/merged", spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), 0
    rows = rows.withColumn("window_start", F.lit("2024-01-01").cast("timestamp")).coalesce(1)
    for number in range(30):
        folder = admission._counts_folder(f"{state}/counts", 0, number)
        rows.write.mode("overwrite").parquet(folder)
        if number in (8, 26):  # the step broke off with some parts left, and runs again
            kept = {p: spark.read.parquet(p).collect() for p in jobs.folders(spark, f"{state}/counts/level=0/batch=*")}
            admission._merge(spark, f"{state}/counts", ["k", "window_start"], number, 3)
            for path, old in list(kept.items())[:2]:
                spark.createDataFrame(old, rows.schema).write.parquet(path)
        else:
            admission._merge(spark, f"{state}/counts", ["k", "window_start"], number, 3)
        if number % 9 == 8 or number == 26:
            found = {r.k: r.n for r in admission.read_counts(spark, state, width=3).groupBy("k").agg(F.sum("n").alias("n")).collect()}
            assert found == {"a": number + 1, "b": 2 * (number + 1)}
        admission._merge(spark, f"{state}/counts", ["k", "window_start"], number, 3)
        most = max(most, len(jobs.folders(spark, f"{state}/counts/level=*/batch=*")))
    assert most <= 2 * 4 + 1


def test_merged_durations(spark):
    rows = [(p, 86400 * (i % 5), i * i % 977, None if p == "a" else "bad") for p in "ab" for i in range(1000)]
    df = spark.createDataFrame(rows, "process string, at int, s int, error string").select(
        "process", "error", F.timestamp_seconds("at").alias("started_at"), F.timestamp_seconds(F.col("at") + F.col("s")).alias("ended_at")
    )
    daily = routing.duration_sketches(df)
    assert daily.select("day").distinct().count() == 5
    exact = sorted(i * i % 977 for i in range(1000))
    for row in routing.merged_durations(daily).collect():
        assert (row.n_runs, row.max_seconds, round(row.avg_seconds, 6)) == (1000, max(exact), round(sum(exact) / 1000, 6))
        below, upto = sum(s < row.quantile_seconds for s in exact), sum(s <= row.quantile_seconds for s in exact)
        assert below <= 1000 * (0.5 + routing.SKETCH_ERROR) and upto >= 1000 * (0.5 - routing.SKETCH_ERROR)


def test_delivery_sends_the_processes_of_hot_groups(spark, monkeypatch):
    """Few processes go to the events; among many, those of groups with many events do."""
    events = spark.createDataFrame([(i, "g0" if i % 5 else f"g{i % 3}") for i in range(60)] + [(60, None), (60, "g1")], "event_id int, group_id string")
    processes = spark.createDataFrame([("g0", "a"), ("g1", "b"), ("g1", "c"), ("g1", "c"), (None, "d"), ("g9", "e")], "group_id string, name string")
    named = {"g0": ["a"], "g1": ["b", "c", "c"]}
    wanted = sorted((r.group_id, r.event_id, p) for r in events.collect() for p in named.get(r.group_id, []))
    found = routing.broadcast_events(events, processes)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["group_id", "event_id", "process"] and sorted(map(tuple, found.collect())) == wanted
    monkeypatch.setattr(routing, "small_enough", lambda df: False)
    for limit in (10, 1000):
        found = routing.broadcast_events(events, processes, limit=limit)
        assert found.columns == ["group_id", "event_id", "process"] and sorted(map(tuple, found.collect())) == wanted

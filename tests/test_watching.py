"""Change detection against a direct fold over the polls, batch and streamed."""

import os
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import changes, triggers
from tidewatch.streaming.updates import stream_branch_updates, stream_pr_updates

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "poll_ts timestamp, repo string, number long, base_ref string, oid string, committed_at timestamp, "
    "comment_id string, comment_at timestamp, comment_body string"
)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def histories(seed, n_polls=40, n_prs=8):
    """Random poll logs: a pull request gains commits and comments over time."""
    rng = random.Random(seed)
    rows, state, serial = [], {}, 0
    for poll in range(n_polls):
        now = poll * 600
        for number in range(n_prs):
            if rng.random() < 0.3 and number not in state:
                serial += 1
                state[number] = [f"c{serial}", now - rng.randint(0, 900), None, None, None]
            if number not in state:
                continue
            pr = state[number]
            if rng.random() < 0.25:
                serial += 1
                pr[0], pr[1] = f"c{serial}", now - rng.randint(0, 900)
            if rng.random() < 0.25:
                serial += 1
                # bodies repeat: such a comment is no news and raises no mark
                pr[2], pr[3], pr[4] = f"m{serial}", now - rng.randint(0, 300), f"body {serial % 3}"
            rows.append(
                (at(now), f"org/r{number % 2}", number, "master" if number != 3 else "dev", pr[0], at(pr[1]), pr[2], None if pr[3] is None else at(pr[3]), pr[4])
            )
    return rows


WATCHES = [("one", "org/r0", "master"), ("any", "org/r1", ""), ("dev", "org/r1", "^dev"), ("all", "org/r1", ".")]


def fold(rows, start):
    """Every watch on its own, one poll after the other."""
    out = set()
    for watch, repo, pattern in WATCHES:
        mark, cache = start, {}
        for poll in sorted({r[0] for r in rows}):
            emitted = []
            for _, _, number, base, oid, committed, comment, commented, body in [r for r in rows if (r[0], r[1]) == (poll, repo)]:
                updated = committed if commented is None else max(committed, commented)
                if not re.search(pattern or "master", base) or updated <= mark:
                    continue
                old = cache.get(number)
                if old is None:
                    new_commit, new_comment = committed > mark, bool(comment)
                else:
                    new_commit, new_comment = old[0] != oid, old[1] != (body or "")
                cache[number] = (oid, body or "")
                if new_commit or new_comment:
                    emitted.append(updated)
                    out.add((watch, poll, repo, number, oid, new_commit, new_comment))
            mark = max([mark, *emitted])
    return out


def rules(spark):
    return spark.createDataFrame(WATCHES, "watch string, repo string, branch_pattern string")


def found(df):
    return {(r.watch, r.poll_ts, r.repo, r.number, r.oid, r.new_commit, r.new_comment) for r in df.collect()}


@pytest.mark.parametrize("seed,limit", [(1, 10**6), (2, 10**6), (7, 10**6), (3, 20)])
def test_pull_request_updates(spark, seed, limit):
    rows = histories(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = changes.pull_request_updates(df, rules(spark), F.lit(at(1000)), limit=limit)
    assert found(got) == fold(rows, at(1000))


def write_polls(spark, rows, folder, schema, cuts):
    """One file per stretch of polls, oldest first."""
    polls = sorted({r[0] for r in rows})
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(polls)], strict=True)):
        part = [r for r in rows if polls[a] <= r[0] <= polls[b - 1]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")


def test_streamed_pull_request_updates(spark, tmp_path):
    rows = histories(4)
    folder, state = f"{tmp_path}/polls", f"{tmp_path}/state"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for end in (12, 25, 40):  # three runs of the stream, as files arrive
            polls = sorted({r[0] for r in rows})
            start = {12: 0, 25: 12, 40: 25}[end]
            part = [r for r in rows if polls[start] <= r[0] <= polls[end - 1]]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            got = stream_pr_updates(stream, rules(spark), F.lit(at(1000)), state)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found(got) == fold(rows, at(1000))


def test_a_step_that_broke_off_is_done_again(spark, tmp_path):
    rows = histories(8, n_polls=20)
    folder, state = f"{tmp_path}/polls", f"{tmp_path}/state"
    polls = sorted({r[0] for r in rows})
    half = [r for r in rows if r[0] <= polls[9]]
    spark.createDataFrame(half, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    # what a crash leaves: a folder without the mark of a finished write
    os.makedirs(f"{state}/updates/batch=0")
    (tmp_path / "state" / "updates" / "batch=0" / "part-0.parquet").write_bytes(b"half")
    for part in (None, [r for r in rows if r[0] > polls[9]]):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        got = stream_pr_updates(stream, rules(spark), F.lit(at(100)), state)
    assert found(got) == fold(rows, at(100))


def test_versions_are_forgotten(spark, tmp_path):
    rows = [
        (at(10), "org/r0", 1, "master", "a", at(1), None, None, None),
        (at(5000), "org/r0", 2, "master", "b", at(4999), None, None, None),
        (at(5010), "org/r0", 1, "master", "a", at(1), "m", at(5005), "hi"),
    ]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = stream_pr_updates(stream, rules(spark), F.lit(T0), f"{tmp_path}/state", forget="1 day")
    versions = spark.read.parquet(f"{tmp_path}/state/versions/batch=1")
    assert [r.number for r in versions.collect()] == [2]
    last = [r for r in got.collect() if r.poll_ts == at(5010)]
    assert [(r.number, r.new_commit, r.new_comment) for r in last] == [(1, False, True)]


def test_a_comment_with_the_same_body_is_no_news_and_raises_no_mark(spark):
    rows = [
        (at(10), "org/r0", 1, "master", "a", at(1), "m1", at(5), "same"),
        (at(20), "org/r0", 1, "master", "a", at(1), "m2", at(15), "same"),
        (at(30), "org/r0", 2, "master", "b", at(14), None, None, None),
        (at(30), "org/r0", 4, "master", "d", at(16), None, None, None),
    ]
    got = changes.pull_request_updates(spark.createDataFrame(rows, SCHEMA), rules(spark), F.lit(T0))
    assert {(r.poll_ts, r.number) for r in got.collect()} == {(at(10), 1), (at(30), 2), (at(30), 4)}


def test_two_watches_have_two_marks(spark):
    """The release is seen first; the older change of master is not lost for that."""
    rows = [
        (at(10), "r", 1, "release", "a", at(9), None, None, None),
        (at(30), "r", 2, "master", "b", at(5), None, None, None),
    ]
    ruled = spark.createDataFrame([("m", "r", "master"), ("l", "r", "release")], "watch string, repo string, branch_pattern string")
    got = changes.pull_request_updates(spark.createDataFrame(rows, SCHEMA), ruled, F.lit(T0))
    assert {(r.watch, r.number) for r in got.collect()} == {("l", 1), ("m", 2)}


BRANCHES = "poll_ts timestamp, repo string, name string, oid string, committed_at timestamp"


def test_branch_updates_batch_and_stream(spark, tmp_path):
    rows = [
        (at(10), "r", "a", "1", at(5)),
        (at(10), "r", "b", "2", at(-5)),  # before the start: never seen
        (at(20), "r", "a", "1", at(5)),
        (at(20), "r", "c", "3", at(4)),  # below the mark, lost
        (at(30), "r", "a", "4", at(25)),
        (at(30), "r", "d", "5", at(26)),
        (at(40), "r", "d", "5", at(39)),  # newer time, same head
    ]
    df = spark.createDataFrame(rows, BRANCHES)
    expected = {(at(10), "a"), (at(30), "a"), (at(30), "d")}
    assert {(r.poll_ts, r.name) for r in changes.branch_updates(df, F.lit(T0)).collect()} == expected
    folder = f"{tmp_path}/heads"
    for r in (rows[:4], rows[4:]):
        spark.createDataFrame(r, BRANCHES).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(BRANCHES).parquet(folder)
    got = stream_branch_updates(stream, F.lit(T0), f"{tmp_path}/state")
    assert {(r.poll_ts, r.name) for r in got.collect()} == expected


RULE = "watch string, repo string, approval_required boolean, teams array<string>, retest_pattern string"


def test_triggers_and_gate(spark):
    ruled = spark.createDataFrame([("w1", "o/open", False, [], ""), ("w2", "o/closed", True, ["o/core"], ""), ("w3", "o/closed", False, [], "^again$")], RULE)
    members = spark.createDataFrame([("o", "core", "ann"), ("o", "core", "ann"), ("o", "other", "bob")], "org string, slug string, login string")
    allowed = changes.approvers(members, ruled)
    assert [tuple(r) for r in allowed.collect()] == [("w2", "ann")]
    cases = [
        # repo, number, commit?, comment?, message, body, commenter, author -> trigger
        ("o/open", 1, False, True, "m", "retest this please", "bob", "bob", "retest"),
        ("o/closed", 2, False, True, "m", "retest this please", "bob", "bob", None),
        ("o/closed", 3, False, True, "m", "retest this please", "ann", "bob", "retest"),
        ("o/closed", 4, False, True, "m", "it is ok to test", "ann", "bob", "approval"),
        ("o/open", 5, False, True, "m", "it is ok to test", "ann", "bob", None),
        ("o/open", 6, True, True, "m", "hello", "ann", "bob", "commit"),
        ("o/open", 7, True, False, "m skip ci", None, None, "bob", None),
        ("o/closed", 8, True, False, "multi\nline skip ci\nmore", None, None, "ann", None),
        ("o/closed", 9, True, False, "m", None, None, "ann", "commit"),
    ]
    schema = "repo string, number long, new_commit boolean, new_comment boolean, message string, comment_body string, comment_author string, author_login string"
    updates = spark.createDataFrame([c[:-1] for c in cases], schema).withColumn("watch", F.when(F.col("repo") == "o/open", "w1").otherwise("w2"))
    fired = triggers.pr_triggers(updates, ruled, allowed)
    assert {r.number: r.trigger for r in fired.collect()} == {c[1]: c[-1] for c in cases if c[-1]}
    comments = spark.createDataFrame(
        [("o/closed", 3, 2, "ok to test!", "ann"), ("o/closed", 3, 1, "ok to test", "ann"), ("o/closed", 4, 1, "ok to test", "bob")],
        "repo string, number long, position int, body string, author_login string",
    )
    passed = {r.number: (r.approved_by, r.approval_body) for r in triggers.approval_gate(fired, comments, allowed, ruled).collect()}
    assert passed == {1: (None, None), 3: ("ann", "ok to test"), 6: (None, None), 9: (None, None)}
    assert triggers.rules_without_teams(spark.createDataFrame([("w", "o/x", True, [], "")], RULE)).count() == 1


def test_heads_touching_a_folder(spark):
    commits = spark.createDataFrame(
        [("r", "a", "1", at(1), ["src/x"]), ("r", "a", "2", at(2), ["docs/y"]), ("r", "b", "3", at(3), ["src/z", "t"]), ("r", "c", "4", at(4), ["srcs/z"])],
        "repo string, ref string, oid string, committed_at timestamp, files array<string>",
    )
    heads = spark.createDataFrame([("r", "a", "2"), ("r", "b", "3"), ("r", "c", "4")], "repo string, ref string, oid string")
    assert [r.ref for r in changes.branch_heads_touching(heads, commits, "src/").collect()] == ["b"]
    assert changes.branch_heads_touching(heads, commits).count() == 3

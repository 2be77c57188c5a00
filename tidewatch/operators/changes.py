"""Change detection over polls of repositories: which pull requests and
branches are new or changed since the watcher last looked."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import last_updated, required_value, split_repo
from tidewatch.operators.settings import matches_pattern, with_rule_defaults
from tidewatch.plans.expand import explode_range
from tidewatch.plans.ordered import HOT_ROWS, OrderedGroups, bounded_broadcast, join_same, latest, with_previous
from tidewatch.session import cut


def poll_snapshots(
    changes: DataFrame, keys: list[str], ts: str, start: Column, end: Column, period_seconds: int, *, limit: int = HOT_ROWS
) -> DataFrame:
    """The entity table as a watcher sees it at each tick (``poll_ts``).

    A version is visible at the ticks from its own time up to the next version
    of the same entity. Ticks are evenly spaced (the first one period after
    ``start``), so each version works out its own ticks and no join on time is
    needed.
    """
    if period_seconds <= 0:
        raise ValueError("a ticker needs a period")
    ties = [c for c in changes.columns if c not in (*keys, ts) and not _unordered(changes, c)]
    versions = with_previous(changes, keys, [ts, *ties], {"__next": ts}, reverse=True, limit=limit)
    origin, step = F.unix_micros(start), F.lit(period_seconds * 1_000_000)

    def ticks_before(at: Column) -> Column:
        return F.ceil((F.unix_micros(at) - origin) / step).cast("long") - 1

    n_ticks = F.floor((F.unix_micros(end) - origin) / step).cast("long")
    first = F.greatest(F.lit(1), ticks_before(F.col(ts)) + 1)
    final = F.least(n_ticks, F.coalesce(ticks_before(F.col("__next")), n_ticks))
    ticks = explode_range(versions, first, final, "__n")
    return ticks.select(F.timestamp_micros(origin + F.col("__n") * step).alias("poll_ts"), *changes.columns)


def _unordered(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def since_high_water(df: DataFrame, marks: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows strictly newer than their key's mark; keys without a mark pass."""
    known = marks.select(*keys, F.col("mark").alias("__mark"))
    joined = df.join(known, keys, "left")
    return joined.filter(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")


def raise_marks(marks: DataFrame, kept: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Marks after a poll: the newest kept time per key, never falling."""
    fresh = kept.groupBy(*keys).agg(F.max(ts).alias("mark"))
    return marks.select(*keys, "mark").unionByName(fresh).groupBy(*keys).agg(F.max("mark").alias("mark"))


def with_watch(rules: DataFrame) -> DataFrame:
    """Rules with their patterns filled in and the ``watch`` each of them is: a
    repository may have several. Without such a column, the repository's only one."""
    filled = with_rule_defaults(rules)
    return filled if "watch" in rules.columns else filled.withColumn("watch", F.col("repo"))


def poll_marks(polls: DataFrame) -> DataFrame:
    """Per watch and poll: the newest update of all rows, and of those that count
    for the mark (not ``silent``). The one small table all marks come from."""
    dated = polls.filter(F.col("watch").isNotNull() & F.col("poll_ts").isNotNull() & F.col("last_updated").isNotNull())
    return dated.groupBy("watch", F.to_date("poll_ts").alias("__day"), "poll_ts").agg(
        F.max("last_updated").alias("__newest"), F.max(F.when(~F.col("silent"), F.col("last_updated"))).alias("__counted")
    )


def newer_than_mark(polls: DataFrame, per_poll: DataFrame, start: Column, marks: DataFrame | None = None) -> DataFrame:
    """Rows of ``polls`` newer than their watch's mark at their poll.

    The mark before a poll is the newest counted update of any earlier poll, the
    one in ``marks`` (watch, mark) or ``start``. It is worked out on one row per
    (watch, poll): within a day, and then from day to day, so no window holds
    more than a day of polls.
    """
    per_day = per_poll.groupBy("watch", "__day").agg(F.max("__counted").alias("__of_day"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    days = per_day.select("watch", "__day", F.max("__of_day").over(earlier(["watch"], "__day")).alias("__before"))
    if marks is not None:
        known = marks.select("watch", F.col("mark").alias("__known"))
        days = days.join(known, "watch", "left").select("watch", "__day", F.greatest("__before", "__known").alias("__before"))
    today = per_poll.withColumn("__today", F.max("__counted").over(earlier(["watch", "__day"], "poll_ts")))
    at_poll = (
        today.join(days, ["watch", "__day"])
        .withColumn("mark", F.greatest(start, "__before", "__today"))
        .filter(F.col("__newest") > F.col("mark"))
        .select("watch", "poll_ts", "mark")
    )
    return polls.join(at_poll, ["watch", "poll_ts"]).filter(F.col("last_updated") > F.col("mark"))


def watch_polls(
    polls: DataFrame,
    keys: list[str],
    version: Column,
    news: dict[str, Column],
    start: Column,
    *,
    marks: DataFrame | None = None,
    versions: DataFrame | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """All rows above their watch's mark, with the columns of ``news`` (over the
    remembered ``version`` before the row, ``__prev``) and ``silent``: no news.

    Only rows with news raise the mark. Which these are depends on the marks, so a round
    works the marks out with a guess of the silent rows: first those without news
    against the row before, whatever the mark, then those that the round before found. Where a watch's silent rows turn out as guessed, it is
    done. Else it is settled up to the first poll where they differ, as nothing that lies
    before depends on the guess; the next round begins there, with the mark and
    versions reached, for the watches concerned only. The polls are read once and written
    down; each round settles a poll at least.
    ``marks`` (watch, mark) and ``versions`` (watch, keys, version) are what earlier polls
    left.
    """
    entity = ["watch", *keys]
    polls = cut(polls.filter(F.col("last_updated") > start))  # no mark is below the start

    def judged(rows: DataFrame, versions: DataFrame | None, is_light: bool) -> DataFrame:
        """Rows with a mark: the version before, the news and whether there is none."""
        groups = OrderedGroups.of_light(rows, entity, ["poll_ts"]) if is_light else OrderedGroups.split(rows, entity, ["poll_ts"], limit)
        seen = groups.running({"__prev": latest(version)}).rows()
        if versions is not None:
            known = versions.select(*entity, F.col("version").alias("__known"))
            seen = join_same(seen, known, entity, "left").withColumn("__prev", F.coalesce("__prev", "__known")).drop("__known")
        seen = seen.withColumns(news)
        has_news = functools.reduce(lambda a, b: a | b, [F.col(n) for n in news])
        return seen.withColumn("silent", ~F.coalesce(has_news, F.lit(False)))

    # an entity is in a poll once, so it has no more rows than its watch has polls
    n_polls = polls.groupBy("watch").agg(F.count_distinct("poll_ts").alias("n"))
    is_light = (n_polls.agg(F.max("n")).first()[0] or 0) <= limit
    guess = judged(polls.withColumn("mark", start), versions, is_light)
    todo, silent = polls, cut(guess.filter("silent").select(*entity, "poll_ts").distinct())
    guessed = "__guessed"
    settled: list[DataFrame] = []
    while True:
        told = join_same(todo, silent.withColumn("silent", F.lit(True)), [*entity, "poll_ts"], "left")
        told = told.withColumn("silent", F.coalesce("silent", F.lit(False)))
        fresh = newer_than_mark(told.withColumnRenamed("silent", guessed), poll_marks(told), start, marks)
        seen = cut(judged(fresh, versions, is_light))
        wrong = cut(seen.filter(F.col("silent") != F.col(guessed)).groupBy("watch").agg(F.min("poll_ts").alias("__until")))
        seen = seen.drop(guessed)
        n_wrong = wrong.count()
        if n_wrong == 0:
            return functools.reduce(DataFrame.unionByName, [*settled, seen])
        wrong = bounded_broadcast(wrong, n_wrong)
        right = seen.join(wrong, "watch", "left").filter(F.col("__until").isNull() | (F.col("poll_ts") <= F.col("__until")))
        settled.append(right.drop("__until"))
        after = lambda rows, side=wrong: rows.join(side, "watch").filter(F.col("poll_ts") > F.col("__until")).drop("__until")
        todo, silent = after(polls), after(seen.filter("silent").select(*entity, "poll_ts")).distinct()
        marks, versions = _left_behind(right.filter("__until is not null"), wrong, entity, version, marks, versions)
        if len(settled) > 1:  # else they stand right behind a cut
            marks, versions = cut(marks), cut(versions)


def _left_behind(
    right: DataFrame, wrong: DataFrame, entity: list[str], version: Column, marks: DataFrame | None, versions: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Marks and versions of the watches in ``wrong`` after their settled rows."""
    raised = right.filter(~F.col("silent")).groupBy("watch").agg(F.max("last_updated").alias("mark"))
    newest = right.groupBy(*entity).agg(F.max_by(version, "poll_ts").alias("version"))
    if marks is not None:
        before = marks.join(wrong, "watch", "left_semi")
        raised = raised.unionByName(before).groupBy("watch").agg(F.max("mark").alias("mark"))
    if versions is not None:
        before = versions.select(*entity, "version").join(wrong, "watch", "left_semi")
        newest = newest.unionByName(join_same(before, newest.select(*entity), entity, "left_anti"))
    return raised, newest


def watched_pull_requests(polls: DataFrame, rules: DataFrame) -> DataFrame:
    """Polled pull requests once per watch on their base branch, with ``last_updated``."""
    wanted = with_watch(rules).select("watch", "repo", F.col("branch_pattern").alias("__pattern"))
    return (
        polls.join(wanted, "repo")
        .filter(matches_pattern(F.col("base_ref"), F.col("__pattern"), "branch_pattern"))
        .drop("__pattern")
        .withColumn("last_updated", last_updated(F.col("committed_at"), F.col("comment_at")))
    )


def pull_request_version() -> Column:
    """What is remembered of a pull request between polls."""
    return F.struct("oid", F.coalesce("comment_body", F.lit("")).alias("body"))


def pull_request_news() -> dict[str, Column]:
    """``new_commit`` and ``new_comment`` against the version before, ``__prev``."""
    first = F.col("__prev").isNull()
    has_comment = F.coalesce("comment_id", F.lit("")) != ""
    body = F.coalesce("comment_body", F.lit(""))
    return {
        "new_commit": F.when(first, F.col("committed_at") > F.col("mark")).otherwise(F.col("__prev.oid") != F.col("oid")),
        "new_comment": F.when(first, has_comment).otherwise(F.col("__prev.body") != body),
    }


def pull_request_updates(polls: DataFrame, rules: DataFrame, start: Column, *, limit: int = HOT_ROWS) -> DataFrame:
    """Pull requests with a new commit or comment, per watch and poll.

    ``polls``: poll_ts, repo, number, base_ref, oid, committed_at, comment_id,
    comment_at, comment_body and any other columns. Adds ``watch``,
    ``last_updated``, ``mark``, ``new_commit`` and ``new_comment``.
    """
    watched = watched_pull_requests(polls, rules)
    seen = watch_polls(watched, ["repo", "number"], pull_request_version(), pull_request_news(), start, limit=limit)
    return seen.filter(~F.col("silent")).drop("silent", "__prev")


def watched_branches(polls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Polled branches once per watch on their repository (one without rules)."""
    dated = polls.withColumn("last_updated", F.col("committed_at"))
    if rules is None:
        return dated.withColumn("watch", F.col("repo"))
    return dated.join(with_watch(rules).select("watch", "repo"), "repo")


def branch_news() -> dict[str, Column]:
    return {"is_new": F.col("__prev").isNull() | (F.col("__prev.oid") != F.col("oid"))}


def branch_updates(polls: DataFrame, start: Column, rules: DataFrame | None = None, *, limit: int = HOT_ROWS) -> DataFrame:
    """Branches whose head changed, per watch and poll; ``polls``: poll_ts, repo,
    name, oid, committed_at. No branch pattern applies. Adds ``watch``, ``mark``."""
    seen = watch_polls(watched_branches(polls, rules), ["repo", "name"], F.struct("oid"), branch_news(), start, limit=limit)
    return seen.filter(~F.col("silent")).drop("silent", "__prev", "is_new", "last_updated")


def open_prs_with_latest(prs: DataFrame, commits: DataFrame, comments: DataFrame) -> DataFrame:
    """Open pull requests with their last commit and last comment (structs;
    NULL when there is none). The last one is the newest, ties by id."""
    keys = ["repo", "number"]
    still_open = prs.filter(F.upper("state") == "OPEN")

    def newest(rows: DataFrame, ts: str, key: str, name: str) -> DataFrame:
        body = F.struct(*[c for c in rows.columns if c not in keys])
        return rows.join(still_open.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max_by(body, F.struct(ts, key)).alias(name))

    return (
        still_open.join(newest(commits, "committed_at", "oid", "last_commit"), keys, "left")
        .join(newest(comments, "created_at", "id", "last_comment"), keys, "left")
    )


def branch_heads_touching(heads: DataFrame, commits: DataFrame, path: str = "") -> DataFrame:
    """Branch heads whose commit is the newest one that touched ``path``.

    ``heads``: repo, ref, oid. ``commits``: repo, ref, oid, committed_at, files.
    A file is under the path when it equals it or lies in that directory.
    """
    folder = path.strip("/")
    touching = commits
    if folder:
        touching = commits.filter(F.exists("files", lambda f: (f == folder) | f.startswith(folder + "/")))
    newest = touching.groupBy("repo", "ref").agg(F.max_by("oid", F.struct("committed_at", "oid")).alias("oid"))
    return heads.join(newest, ["repo", "ref", "oid"])


def modified_files(pr_files: DataFrame) -> DataFrame:
    """One row per changed file of a pull request."""
    return pr_files.select("repo", "number", F.explode("files").alias("file"))


def approvers(team_members: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct logins over the teams (``org/slug``) each watch lists."""
    listed = with_watch(rules).select("watch", F.explode("teams").alias("__team")).select(
        "watch", split_repo(F.col("__team")).alias("__team")
    )
    wanted = listed.filter(F.col("__team").isNotNull()).select(
        "watch", F.col("__team.owner").alias("org"), F.col("__team.name").alias("slug")
    )
    members = team_members.filter(required_value(F.col("login")).isNotNull())
    return members.join(wanted, ["org", "slug"]).select("watch", "login").distinct()

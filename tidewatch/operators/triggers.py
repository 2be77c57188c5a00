"""Trigger and approval rules: which detected changes start a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.changes import with_watch
from tidewatch.operators.settings import matches_pattern

_RULE_COLUMNS = ["approval_required", "approval_pattern", "retest_pattern", "skip_pattern"]


def _with_rules(updates: DataFrame, rules: DataFrame) -> DataFrame:
    return updates.join(with_watch(rules).select("watch", *_RULE_COLUMNS), "watch")


def _with_approver(rows: DataFrame, approvers: DataFrame, login: str, flag: str) -> DataFrame:
    known = approvers.select("watch", F.col("login").alias(login), F.lit(True).alias(flag)).distinct()
    return rows.join(known, ["watch", login], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def pr_triggers(updates: DataFrame, rules: DataFrame, approvers: DataFrame) -> DataFrame:
    """Updates that fire, with ``trigger`` naming the rule: retest, approval or commit.

    ``updates`` as produced by ``pull_request_updates`` with ``message`` and
    ``comment_author``; ``approvers``: watch, login. Every
    update is judged by the rule of its own watch.
    """
    ruled = _with_approver(_with_rules(updates, rules), approvers, "comment_author", "__by_approver")
    required = F.coalesce("approval_required", F.lit(False))
    body = F.coalesce("comment_body", F.lit(""))
    message = F.coalesce("message", F.lit(""))
    retest = F.col("new_comment") & matches_pattern(body, F.col("retest_pattern"), "retest_pattern") & (~required | F.col("__by_approver"))
    approval = F.col("new_comment") & required & F.col("__by_approver") & matches_pattern(body, F.col("approval_pattern"), "approval_pattern")
    commit = F.col("new_commit") & ~matches_pattern(message, F.col("skip_pattern"), "skip_pattern")
    fired = ruled.withColumn("trigger", F.when(retest, "retest").when(approval, "approval").when(commit, "commit"))
    return fired.filter(F.col("trigger").isNotNull()).select(*updates.columns, "trigger")


def branch_triggers(updates: DataFrame, rules: DataFrame) -> DataFrame:
    """Branch updates whose commit message does not ask to skip."""
    ruled = _with_rules(updates, rules)
    skipped = matches_pattern(F.coalesce("message", F.lit("")), F.col("skip_pattern"), "skip_pattern")
    return ruled.filter(~skipped).select(*updates.columns)


def approval_gate(fired: DataFrame, comments: DataFrame, approvers: DataFrame, rules: DataFrame) -> DataFrame:
    """Fired pull requests that may run.

    Where approval is required, the last commit is by an approver
    (``author_login``) or some comment by an approver matches the pattern; the
    first such comment is returned in ``approved_by`` and ``approval_body``.
    """
    ruled = _with_approver(_with_rules(fired, rules), approvers, "author_login", "__own")
    patterns = with_watch(rules).filter("approval_required").select("watch", "repo", "approval_pattern")
    matching = (
        comments.select("repo", "number", "position", "body", F.col("author_login").alias("login"))
        .join(patterns, "repo")
        .filter(matches_pattern(F.coalesce("body", F.lit("")), F.col("approval_pattern"), "approval_pattern"))
        .join(approvers.select("watch", "login").distinct(), ["watch", "login"], "left_semi")
    )
    first = matching.groupBy("watch", "repo", "number").agg(F.min_by(F.struct("login", "body"), "position").alias("__first"))
    gated = ruled.join(first, ["watch", "repo", "number"], "left")
    required = F.coalesce("approval_required", F.lit(False))
    needs_comment = required & ~F.col("__own")
    return gated.filter(~needs_comment | F.col("__first").isNotNull()).select(
        *fired.columns,
        F.when(needs_comment, F.col("__first.login")).alias("approved_by"),
        F.when(needs_comment, F.col("__first.body")).alias("approval_body"),
    )


def rules_without_teams(rules: DataFrame) -> DataFrame:
    """Rules that require approval and list no team: a watch on them is an error."""
    return rules.filter(F.col("approval_required") & (F.coalesce(F.size("teams"), F.lit(0)) <= 0))


def branch_approval_gate(fired: DataFrame, approvers: DataFrame, rules: DataFrame) -> DataFrame:
    """Fired branches that may run: where approval is required, the author must
    be an approver."""
    ruled = _with_approver(_with_rules(fired, rules), approvers, "author_login", "__own")
    required = F.coalesce("approval_required", F.lit(False))
    return ruled.filter(~required | F.col("__own")).select(*fired.columns)

"""Row rules: one output row per broken rule."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import required_value, split_repo
from tidewatch.operators.outcomes import STATES

COPY_KINDS = ["local", "s3"]
LOG_OUTPUTS = ["stackdriver", "stdout"]


def _missing(name: str) -> Column:
    return required_value(F.col(name)).isNull()


def _given(*names: str) -> Column:
    """How many of the fields are given."""
    return functools.reduce(lambda a, b: a + b, [(~_missing(n)).cast("int") for n in names])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` rows with the name of each rule they break. A rule is the Column
    that holds where it is broken."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select("*", F.explode(broken).alias("rule"))


def repo_rules() -> dict[str, Column]:
    """A clone: url and target, and exactly one of hash, tag and branch."""
    found = _given("hash", "tag", "branch")
    return {
        "url required": _missing("url"),
        "into required": _missing("into"),
        "one of hash, tag, branch required": found == 0,
        "only one of hash, tag, branch": found > 1,
    }


def status_rules() -> dict[str, Column]:
    return {"state required": _missing("state"), "state not valid": ~_missing("state") & ~F.col("state").isin(STATES)}


def watch_rules() -> dict[str, Column]:
    teams = F.coalesce(F.size("teams"), F.lit(0))
    return {
        "repo required": _missing("repo"),
        "repo malformed": ~_missing("repo") & split_repo(F.col("repo")).isNull(),
        "teams required": F.coalesce("approval_required", F.lit(False)) & (teams <= 0),
    }


def script_rules() -> dict[str, Column]:
    """A script has a command or arguments, not both."""
    args = F.coalesce(F.size("args"), F.lit(0)) > 0
    return {"command or args required": _missing("command") & ~args, "only one of command, args": ~_missing("command") & args}


def copy_rules() -> dict[str, Column]:
    """A copy goes from local to remote or back."""
    known = F.col("src_kind").isin(COPY_KINDS) & F.col("dest_kind").isin(COPY_KINDS)
    return {
        "source not supported": ~F.coalesce(F.col("src_kind").isin(COPY_KINDS), F.lit(False)),
        "destination not supported": ~F.coalesce(F.col("dest_kind").isin(COPY_KINDS), F.lit(False)),
        "source and destination of one kind": known & (F.col("src_kind") == F.col("dest_kind")),
    }


def log_output_rules() -> dict[str, Column]:
    structured = F.col("type") == LOG_OUTPUTS[0]
    given = _given("credentials", "credentials_file")
    return {
        "output type not supported": ~F.coalesce(F.col("type").isin(LOG_OUTPUTS), F.lit(False)),
        "credentials required": structured & (given == 0),
        "only one of credentials, credentials_file": structured & (given == 2),
    }


def image_rules() -> dict[str, Column]:
    """An image has a tag; its secrets have id and file, its arguments key and
    value (arrays of structs)."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return {
        "tag required": _missing("tag"),
        "secret id required": F.exists("secrets", lambda s: empty(s["id"])),
        "secret file required": F.exists("secrets", lambda s: ~empty(s["id"]) & empty(s["file"])),
        "argument key required": F.exists("args", lambda a: empty(a["key"])),
        "argument value required": F.exists("args", lambda a: ~empty(a["key"]) & empty(a["val"])),
    }


def job_rules() -> dict[str, Column]:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return {
        "job name required": _missing("name"),
        "container required": F.coalesce(F.size("containers"), F.lit(0)) <= 0,
        "container image required": F.exists("containers", lambda c: empty(c["image"])),
        "container name required": F.exists("containers", lambda c: ~empty(c["image"]) & empty(c["name"])),
    }


def command_rules() -> dict[str, Column]:
    """A chat command has a name, and field names that are set and unique."""
    names = F.transform("fields", lambda f: F.coalesce(f["name"], F.lit("")))
    return {
        "command name required": _missing("name"),
        "field name required": F.array_contains(names, ""),
        "field defined twice": F.size(F.array_distinct(names)) < F.size(names),
    }

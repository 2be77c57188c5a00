"""Log lines, enrichment, severity, rendering and error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import at_level
from tidewatch.functions.text import required_value, trim_space

# Severities of the levels.
SEVERITY = {
    "trace": "Debug",
    "debug": "Debug",
    "info": "Info",
    "warning": "Warning",
    "warn": "Warning",
    "error": "Error",
    "fatal": "Error",
    "panic": "Error",
}
# Object store codes by class.
STORE_NOT_FOUND = ["NoSuchKey", "NoSuchBucket", "NoSuchUpload", "NotFound"]
STORE_EXISTS = ["BucketAlreadyExists", "BucketAlreadyOwnedByYou"]
VIEWER_URL = "https://console.cloud.google.com/logs/viewer"

_NO_LABELS = "map<string,string>"


def _empty() -> Column:
    return F.create_map().cast(_NO_LABELS)


def log_lines(texts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Non-blank trimmed lines of each text, numbered from 0."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), trim_space), lambda line: line != "")
    return texts.select(*(keep or [c for c in texts.columns if c != text]), F.posexplode(lines).alias("line_no", "line"))


def merge_labels(older: Column, newer: Column) -> Column:
    """Both maps, the newer one winning; NULL counts as empty."""
    old, new = F.coalesce(older, _empty()), F.coalesce(newer, _empty())
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _labels(pairs: dict[str, Column]) -> Column:
    """Map of the labels that have a value."""
    entries = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in pairs.items()])
    return F.map_from_entries(F.array_compact(entries))


def enrich_logs(logs: DataFrame, runs: DataFrame) -> DataFrame:
    """Logs with the fields of their run: id, proc, and of its event the commit
    (first 9 characters), pr and branch. Later fields overwrite earlier ones."""
    added = _labels(
        {
            "id": F.col("run_id"),
            "proc": F.col("process"),
            "commit": F.left("commit", F.lit(9)),
            "pr": F.col("pr"),
            "branch": F.col("branch"),
        }
    )
    known = runs.select("run_id", added.alias("__run_fields"))
    return (
        logs.join(known, "run_id", "left")
        .withColumn("fields", merge_labels(F.col("__run_fields"), F.col("fields")))
        .drop("__run_fields")
    )


def to_log_entries(logs: DataFrame) -> DataFrame:
    """Structured entries: severity, labels as text without ``error``, payload
    with the error text behind the message, and the source location.

    Optional columns: ``traces`` (array of structs path, line, func) and
    ``error_fields`` (map), both of the error.
    """
    has_error = F.col("error").isNotNull()
    severity = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.lower("level")), F.lit("Default")
    )
    labels = F.map_filter(F.coalesce("fields", _empty()), lambda k, _: k != "error")
    location = F.lit(None).cast("struct<file:string,line:bigint,function:string>")
    if "error_fields" in logs.columns:
        own = F.map_filter(F.coalesce("error_fields", _empty()), lambda k, _: k != "error")
        labels = F.when(has_error, merge_labels(labels, own)).otherwise(labels)
    if "traces" in logs.columns:
        first = F.get("traces", F.lit(0))
        location = F.when(
            has_error & first.isNotNull(),
            F.struct(first["path"].alias("file"), first["line"].cast("long").alias("line"), first["func"].alias("function")),
        )
    payload = F.when(has_error, F.concat("message", F.lit(" "), "error")).otherwise(F.col("message"))
    return logs.select("ts", severity.alias("severity"), labels.alias("labels"), payload.alias("payload"), location.alias("source"))


def log_level_filter(logs: DataFrame, level: str = "info", debug: bool = False) -> DataFrame:
    return logs.filter(at_level(F.col("level"), level, debug))


def logs_of_run(logs: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Entries labelled with the run over the last 24 hours."""
    recent = (F.col("ts") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= now)
    return logs.filter((F.element_at("labels", F.lit("id")) == run_id) & recent)


def logs_url(run_id: Column) -> Column:
    """Link to a run's logs of the last day."""
    wanted = F.url_encode(F.concat(F.lit("labels.id="), run_id))
    return F.concat(F.lit(f"{VIEWER_URL}?advancedFilter="), wanted, F.lit("&interval=P1D"))


def render_message(fmt: str, args: list[Column], errors: list[Column] | None = None) -> Column:
    """Formatted message; an argument that is NULL because it failed is replaced
    by its error text, and the message still goes out."""
    problems = errors or [F.lit("value is not defined")] * len(args)
    return F.format_string(fmt, *[F.coalesce(a.cast("string"), e.cast("string")) for a, e in zip(args, problems, strict=True)])


def classify_errors(errors: DataFrame) -> DataFrame:
    """Class of each error by source: cluster (HTTP code and reason), store
    (error code) or any other; unknown ones stay UNCHANGED."""
    code = F.col("http_code")
    cluster = (
        F.when((code == 409) & (F.col("reason") == "AlreadyExists"), "ALREADY_EXISTS")
        .when(code == 404, "NOT_FOUND")
        .when(code == 403, "ACCESS_DENIED")
    )
    store = (
        F.when(F.col("code").isin(STORE_NOT_FOUND), "NOT_FOUND")
        .when(F.col("code").isin(STORE_EXISTS), "ALREADY_EXISTS")
        .when(required_value(F.col("code")).isNotNull(), "BAD_PARAMETER")
    )
    closed = F.col("message").endswith("response body closed") | (F.col("message") == "EOF")
    kind = F.when(F.col("source") == "cluster", cluster).when(F.col("source") == "store", store)
    return errors.withColumn("error_class", F.coalesce(kind, F.when(closed, "STREAM_CLOSED"), F.lit("UNCHANGED")))

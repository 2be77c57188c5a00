"""Cluster jobs: defaults, outcome, completion, owned pods, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import or_default, quantity

# Defaults of a job, in seconds where they are times.
ACTIVE_DEADLINE_SECONDS = 4 * 60 * 60
JOB_TTL_SECONDS = 2 * ACTIVE_DEADLINE_SECONDS
DEFAULT_NAMESPACE = "default"
RESTART_POLICY = "Never"
PULL_POLICY = "Always"


def job_defaults(jobs: DataFrame) -> DataFrame:
    """Jobs with their defaults: kind, namespace, no retries, never restarted,
    time to live, deadline, and images pulled always. ``containers`` is an array
    of structs with image_pull_policy among the fields."""
    return jobs.withColumns(
        {
            "kind": or_default(F.col("kind"), F.lit("Job")),
            "namespace": or_default(F.col("namespace"), F.lit(DEFAULT_NAMESPACE)),
            "backoff_limit": F.coalesce("backoff_limit", F.lit(0)),
            "restart_policy": or_default(F.col("restart_policy"), F.lit(RESTART_POLICY)),
            "ttl_seconds": F.coalesce("ttl_seconds", F.lit(JOB_TTL_SECONDS)),
            "deadline_seconds": F.coalesce("deadline_seconds", F.lit(ACTIVE_DEADLINE_SECONDS)),
            "containers": F.transform(
                "containers",
                lambda c: c.withField("image_pull_policy", or_default(c["image_pull_policy"], F.lit(PULL_POLICY))),
            ),
        }
    )


def job_outcome(job_events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First decisive event of each job: success when it holds a Complete
    condition, else failure with the message of its Failed condition."""
    order = order or ["ts"]

    def of_type(name: str):
        return F.get(F.filter("conditions", lambda c: c["type"] == name), F.lit(0))

    outcome = F.when(of_type("Complete").isNotNull(), F.struct(F.lit("success").alias("outcome"), F.lit("").alias("message"))).when(
        of_type("Failed").isNotNull(), F.struct(F.lit("failure").alias("outcome"), of_type("Failed")["message"].alias("message"))
    )
    decisive = job_events.withColumn("__o", outcome).filter(F.col("__o").isNotNull())
    return (
        decisive.groupBy("namespace", "name")
        .agg(F.min_by(F.struct("__o", *order), F.struct(*order)).alias("__first"))
        .select("namespace", "name", "__first.__o.*", F.col(f"__first.{order[0]}").alias("decided_at"))
    )


def job_complete(jobs: DataFrame) -> DataFrame:
    """Whether each job is done: without a wanted number of completions any
    success with nothing active is enough."""
    done = F.when(F.col("completions").isNull(), (F.col("succeeded") > 0) & (F.col("active") == 0)).otherwise(
        F.col("succeeded") >= F.col("completions")
    )
    return jobs.withColumn("complete", F.coalesce(done, F.lit(False)))


def owned_pods(pods: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pods with an owner of kind Job that is one of ``jobs`` (namespace, name,
    uid, selector) and with every label its selector asks for."""
    owners = pods.withColumn("__owner", F.explode("owners")).filter(F.col("__owner.kind") == "Job")
    wanted = jobs.select("namespace", F.col("name").alias("job"), F.col("uid").alias("__uid"), "selector")
    joined = owners.withColumn("__uid", F.col("__owner.uid")).join(wanted, ["namespace", "__uid"])
    labelled = F.forall(
        F.map_entries(F.coalesce("selector", F.create_map().cast("map<string,string>"))),
        lambda e: F.coalesce(F.element_at("labels", e["key"]) == e["value"], F.lit(False)),
    )
    return joined.filter(labelled).select(*pods.columns, "job").dropDuplicates(["namespace", "name", "job"])


def requested_resources(jobs: DataFrame) -> DataFrame:
    """Requested and limiting amounts per namespace, job and resource.
    ``containers`` hold ``requests`` and ``limits`` maps of quantity texts."""
    containers = jobs.select("namespace", "name", F.explode("containers").alias("c"))
    empty = F.create_map().cast("map<string,string>")
    parts = containers.select(
        "namespace",
        "name",
        F.explode(
            F.concat(
                F.transform(F.map_entries(F.coalesce("c.requests", empty)), lambda e: F.struct(F.lit("request").alias("side"), e["key"].alias("resource"), e["value"].alias("amount"))),
                F.transform(F.map_entries(F.coalesce("c.limits", empty)), lambda e: F.struct(F.lit("limit").alias("side"), e["key"].alias("resource"), e["value"].alias("amount"))),
            )
        ).alias("q"),
    )
    amount = quantity(F.col("q.amount"))
    return parts.groupBy("namespace", "name", F.col("q.resource").alias("resource")).agg(
        F.sum(F.when(F.col("q.side") == "request", amount)).alias("requested"),
        F.sum(F.when(F.col("q.side") == "limit", amount)).alias("limited"),
    )

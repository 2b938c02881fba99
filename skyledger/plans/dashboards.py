"""Dashboards known by title only, rebuilt from the panel kinds over a chosen field list.

One dashboard is one pass over its documents: the fields its panels read are promoted to typed
columns and staged, and every panel then reads only its own columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fields import promote
from skyledger.plans import panels as P
from skyledger.session import stage

# Dashboard, its datasets, its dimensions and its measures.
DASHBOARDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "xray": (("aws.xray",), ("service.name",), ("event.duration",)),
    "lambda": (
        ("aws.lambda_logs",),
        ("aws.lambda.function.name",),
        ("aws.lambda.metrics.Duration.avg", "aws.lambda.metrics.Throttles.sum"),
    ),
    "eks": (
        ("aws.eks",),
        ("aws.eks.cluster.name", "kubernetes.namespace"),
        ("aws.eks.metrics.node_cpu_utilization.avg", "aws.eks.metrics.pod_memory_utilization.avg"),
    ),
    "stepfunctions": (
        ("aws.stepfunctions",),
        ("aws.stepfunctions.state_machine_name", "aws.stepfunctions.status"),
        ("aws.stepfunctions.duration_seconds",),
    ),
    "bedrock": (
        ("aws.bedrock",),
        ("aws.bedrock.model_id", "aws.bedrock.use_case"),
        ("aws.bedrock.invocation_latency_ms", "aws.bedrock.total_token_count"),
    ),
    "aurora": (
        ("aws.aurora",),
        ("aws.aurora.cluster_id", "aws.aurora.engine"),
        ("aws.aurora.replica_lag_seconds", "aws.aurora.db_connections"),
    ),
    "elasticache": (
        ("aws.elasticache",),
        ("aws.dimensions.CacheNodeId",),
        ("aws.elasticache.metrics.CacheHitRate.avg", "event.duration"),
    ),
    "opensearch": (
        ("aws.opensearch",),
        ("aws.opensearch.domain_name", "aws.opensearch.operation"),
        ("aws.opensearch.took_ms", "aws.opensearch.metrics.JVMMemoryPressure.avg"),
    ),
    "cicd": (
        ("aws.codepipeline", "aws.codebuild"),
        ("aws.codepipeline.pipeline_name", "aws.codebuild.project_name"),
        ("aws.codebuild.duration_seconds",),
    ),
    "cognito": (("aws.cognito",), ("event.action", "user.name"), ("event.duration",)),
    "kinesis": (
        ("aws.kinesis",),
        ("aws.dimensions.StreamName",),
        ("aws.kinesis.incoming_bytes", "aws.kinesis.iterator_age_ms"),
    ),
    "kinesisanalytics": (
        ("aws.kinesisanalytics",),
        ("aws.kinesisanalytics.application_name", "aws.kinesisanalytics.runtime"),
        (
            "aws.kinesisanalytics.records_per_second",
            "aws.kinesisanalytics.input_watermark_lag_ms",
            "aws.kinesisanalytics.metrics.checkpoint_duration_ms",
            "aws.kinesisanalytics.metrics.kpu_utilization_pct",
        ),
    ),
}
P.DATASETS.update({name: spec[0] for name, spec in DASHBOARDS.items()})


def streaming_applications(name: str) -> list[P.Panel]:
    """The one of these dashboards whose panels are documented."""
    _, (application, runtime), (records, lag, checkpoint, kpu) = DASHBOARDS[name]
    one = lambda field: (("value", field),)
    return [
        P.Panel(name, "total", "count"),
        P.Panel(name, "failures", "failures"),
        P.Panel(name, "avg_records", "avg", one(records)),
        P.Panel(name, "avg_kpu", "avg", one(kpu)),
        P.Panel(name, "by_application", "share", by=application),
        P.Panel(name, "by_runtime", "share", by=runtime),
        P.Panel(name, "by_outcome", "share", by="event.outcome"),
        P.Panel(name, "records_and_lag", "avg_line", (("records", records), ("lag_ms", lag))),
        P.Panel(name, "checkpoint_over_time", "avg_line", one(checkpoint)),
        P.Panel(name, "kpu_over_time", "avg_line", one(kpu)),
        P.Panel(name, "records_by_application", "avg_by", one(records), by=application),
        P.Panel(name, "failures_over_time", "failures_line"),
    ]


def event_table(name: str, n: int = 100) -> P.Panel:
    """The newest events of the documented dashboard as a table."""
    _, (application, runtime), (records, lag, checkpoint, kpu) = DASHBOARDS[name]
    return P.Panel(
        name, "events", "recent",
        (("application", application), ("runtime", runtime), ("records", records), ("lag_ms", lag),
         ("checkpoint_ms", checkpoint), ("kpu", kpu), ("outcome", "event.outcome"),
         ("error", "error.message")), n=n,
    )


def panels_of(name: str) -> list[P.Panel]:
    """KPIs, outcome share, volumes over time, and one panel per dimension and measure."""
    if name == "kinesisanalytics":
        return streaming_applications(name)
    _, dimensions, measures = DASHBOARDS[name]
    out = [
        P.Panel(name, "total", "count"),
        P.Panel(name, "success_rate", "success_rate"),
        P.Panel(name, "failures", "failures"),
        P.Panel(name, "outcomes", "share", by="event.outcome"),
        P.Panel(name, "over_time", "count_line"),
        P.Panel(name, "failures_over_time", "failures_line"),
    ]
    for i, field in enumerate(dimensions):
        out.append(P.Panel(name, f"by_{i}", "share", by=field))
    for i, field in enumerate(measures):
        series = (("value", field),)
        out.append(P.Panel(name, f"avg_{i}", "avg", series))
        out.append(P.Panel(name, f"avg_over_time_{i}", "avg_line", series))
        out.append(P.Panel(name, f"avg_by_{i}", "avg_by", series, by=dimensions[0]))
    return out


def long_form(panel: P.Panel, df: DataFrame) -> DataFrame:
    """(panel, key, series, value): the key is the group value or the bucket's epoch seconds."""
    key = F.lit("")
    if "bucket" in df.columns:
        key = F.unix_seconds("bucket").cast("string")
    elif "key" in df.columns:
        key = F.col("key")
    values = [c for c in df.columns if c not in ("bucket", "key")]
    wide = df.select(key.alias("key"), *[F.col(c).cast("double").alias(c) for c in values])
    long = wide.unpivot("key", values, "series", "value")
    return long.select(F.lit(panel.key).alias("panel"), "key", "series", "value")


def run(name: str, docs: DataFrame, span: str = "15 minutes") -> DataFrame:
    """All panels of a dashboard in long form, from one scan of the documents."""
    chosen = panels_of(name)
    mine = docs.filter(F.col("dataset").isin(*P.DATASETS[name]))
    narrow = stage(promote(mine, P.hot_fields(chosen)).drop("aws"), f"dashboard-{name}")
    return reduce(
        DataFrame.unionByName, [long_form(p, P.run(p, narrow, span)) for p in chosen]
    )

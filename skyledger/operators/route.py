"""Index naming and routing of documents to data streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.scalars import strip_vendor
from skyledger.sources import registry as R

TRACE_DATASET = "aws.xray"
TRACE_PREFIX = "traces-aws"

# Log group rules, first match wins.
LOG_GROUP_RULES = (("glue", "logs-aws.glue"), ("sagemaker", "logs-aws.sagemaker"))
LOG_GROUP_DEFAULT = "logs-aws.cloudwatch"


def index_name(prefix: Column, dataset: Column) -> Column:
    """``prefix.suffix-default``; the tracing dataset has its own prefix."""
    own = F.when(dataset == TRACE_DATASET, F.lit(TRACE_PREFIX)).otherwise(prefix)
    return F.concat(own, F.lit("."), strip_vendor(dataset), F.lit("-default"))


def route_override(override: Column, prefix: Column, default: Column) -> Column:
    """R2: a per-document dataset override beats the stream the batch arrived with."""
    given = F.nullif(override, F.lit(""))
    return (
        F.when(given.isNull(), default)
        .when(
            given.startswith("aws."),
            F.concat(prefix, F.lit("."), strip_vendor(given), F.lit("-default")),
        )
        .otherwise(F.concat(F.lit("logs-"), given, F.lit("-default")))
    )


def route_by_log_group(log_group: Column, rules=LOG_GROUP_RULES, default=LOG_GROUP_DEFAULT) -> Column:
    """R4."""
    chosen = F.lit(default)
    for needle, index in reversed(rules):
        chosen = F.when(F.lower(log_group).contains(needle), F.lit(index)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(default))


def stream_of(df: DataFrame, event_type: str, service: str = "service_id") -> DataFrame:
    """Where each document belongs: override, else own data_stream, else the registry.

    The override names the stream of a sub-service, which enrichment knows nothing of; so it wins over
    the ``data_stream`` that enrichment filled in.

    Adds ``stream_type``, ``stream_dataset`` and ``stream_namespace`` and drops the override.
    """
    none = F.lit(None).cast("string")
    own = F.col("data_stream") if "data_stream" in df.columns else None
    override = F.nullif(F.col("__dataset"), F.lit("")) if "__dataset" in df.columns else none
    resolved = R.resolve_dataset(F.col(service), event_type) if service in df.columns else none
    part = lambda name: own[name] if own is not None else none
    return df.withColumns(
        {
            "stream_type": F.coalesce(
                F.when(override == TRACE_DATASET, "traces"),
                part("type"),
                F.when(resolved == TRACE_DATASET, "traces"),
                F.lit(event_type),
            ),
            "stream_dataset": F.coalesce(override, part("dataset"), resolved),
            "stream_namespace": F.coalesce(part("namespace"), F.lit("default")),
        }
    ).drop("__dataset")


def fold_subservices(df: DataFrame, parent: Column) -> DataFrame:
    """One parent stream fans out to the sub-datasets its documents name."""
    return df.withColumn("dataset", F.coalesce(F.nullif(F.col("__dataset"), F.lit("")), parent)).drop(
        "__dataset"
    )

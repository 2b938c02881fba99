"""Dashboard panels as declarative specs, turned into DataFrame plans.

A panel names a dashboard, a kind of chart and the fields it reads; ``run`` builds the plan.
Fields are common-schema names resolved by ``functions.fields.pick``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import scalars as X
from skyledger.functions.fields import pick
from skyledger.operators import stats as A

GB = float(X.BYTES_PER_GB)


@dataclass(frozen=True)
class Panel:
    """One panel. ``series`` are (name, field) pairs; ``unit`` divides the measure."""

    dashboard: str
    key: str
    kind: str
    series: tuple[tuple[str, str], ...] = ()
    by: str = ""
    unit: float = 1.0
    n: int = 0
    where: tuple[tuple[str, str], ...] = ()

    @property
    def name(self) -> str:
        return f"{self.dashboard}_{self.key}"


# Which datasets each dashboard reads.
DATASETS: dict[str, tuple[str, ...]] = {
    "glue": ("aws.glue",),
    "sagemaker": ("aws.sagemaker",),
    "emr": ("aws.emr_logs",),
    "athena": ("aws.athena",),
}

_GLUE = "aws.glue.metrics.driver."
_SM = "aws.sagemaker.cloudwatch_metrics."
_EMR = "aws.emr.metrics."
_ATH = "aws.athena.metrics."
_RUN = "aws.{}.job.run_state"


def _series(*fields: str) -> tuple[tuple[str, str], ...]:
    return tuple((f.split("=")[0], f.split("=")[1]) for f in fields)


def _p(dashboard: str, key: str, kind: str, *fields: str, **more) -> Panel:
    return Panel(dashboard, key, kind, _series(*fields), **more)


NS = 1e9
SECONDS = {"unit": NS}
DURATION = "value=event.duration"

# The documented panels with the fields they read.
PANELS = [
    _p("glue", "total_runs", "count"),
    _p("glue", "success_rate", "success_rate"),
    _p("glue", "avg_duration_s", "avg", DURATION, **SECONDS),
    _p("glue", "failed_runs", "failures"),
    _p("glue", "run_outcomes", "share", by="event.outcome"),
    _p("glue", "runs_by_state", "share", by="aws.glue.job.run_state"),
    _p("glue", "failures_by_error_category", "failures_by", by="aws.glue.error_category"),
    _p("glue", "avg_job_duration", "avg_line", DURATION, **SECONDS),
    _p("glue", "jvm_heap_usage", "avg_line", f"value={_GLUE}jvm.heap.usage"),
    _p("glue", "executor_count", "avg_line",
       f"value={_GLUE}ExecutorAllocationManager.executors.numberAllExecutors"),
    _p("glue", "failed_killed_tasks", "stacked",
       f"failed={_GLUE}aggregate.numFailedTasks", f"killed={_GLUE}aggregate.numKilledTasks"),
    _p("glue", "elapsed_time_etl", "avg_line", f"value={_GLUE}aggregate.elapsedTime"),
    _p("glue", "records_read", "sum_line", f"value={_GLUE}aggregate.numRecords"),
    _p("glue", "throughput_by_job", "top", by="aws.glue.job.name", n=10),
    _p("glue", "recent_job_runs", "recent", "job=aws.glue.job.name", "state=aws.glue.job.run_state",
       "outcome=event.outcome", "duration=event.duration", "error_category=aws.glue.error_category",
       n=100),
    _p("sagemaker", "total_invocations", "sum", f"value={_SM}Invocations.sum"),
    _p("sagemaker", "avg_latency_ms", "avg", f"value={_SM}ModelLatency.avg"),
    _p("sagemaker", "total_4xx", "sum", f"value={_SM}Invocations4XXError.sum"),
    _p("sagemaker", "total_5xx", "sum", f"value={_SM}Invocations5XXError.sum"),
    _p("sagemaker", "invocations_over_time", "sum_line", f"value={_SM}Invocations.sum"),
    _p("sagemaker", "model_latency", "avg_line", f"value={_SM}ModelLatency.avg"),
    _p("sagemaker", "errors_4xx_5xx", "sum_line",
       f"errors_4xx={_SM}Invocations4XXError.sum", f"errors_5xx={_SM}Invocations5XXError.sum"),
    _p("sagemaker", "gpu_cpu_utilization", "avg_line",
       f"gpu={_SM}GPUUtilization.avg", f"cpu={_SM}CPUUtilization.avg"),
    _p("sagemaker", "job_outcomes", "share", by="event.outcome"),
    _p("sagemaker", "events_by_job_type", "share", by="aws.sagemaker.job.type"),
    _p("sagemaker", "events_by_action", "top", by="event.action", n=10),
    _p("sagemaker", "training_loss_accuracy", "avg_line",
       "loss=aws.sagemaker.training_loss", "accuracy=aws.sagemaker.accuracy",
       where=(("aws.sagemaker.job.type", "Training"),)),
    _p("sagemaker", "recent_events", "recent", "job=aws.sagemaker.job.name",
       "job_type=aws.sagemaker.job.type", "action=event.action", "outcome=event.outcome",
       "duration=event.duration", n=100),
    _p("emr", "total_jobs", "count"),
    _p("emr", "success_rate", "success_rate"),
    _p("emr", "avg_duration_s", "avg", DURATION, **SECONDS),
    _p("emr", "failed_jobs", "failures"),
    _p("emr", "job_outcomes", "share", by="event.outcome"),
    _p("emr", "jobs_by_application", "share", by="aws.emr.application"),
    _p("emr", "jobs_by_run_state", "share", by="aws.emr.job.run_state"),
    _p("emr", "job_runs_over_time", "count_line"),
    _p("emr", "hdfs_utilisation", "avg_line", f"value={_EMR}hdfs_utilization_pct"),
    _p("emr", "yarn_memory_used", "avg_line", f"value={_EMR}yarn_memory_used_mb"),
    _p("emr", "jvm_heap_usage", "avg_line", f"value={_EMR}jvm_heap_usage"),
    _p("emr", "executor_count", "avg_line", f"value={_EMR}executor_count"),
    _p("emr", "gc_time_ms", "avg_line", f"value={_EMR}gc_time_ms"),
    _p("emr", "completed_failed_tasks", "stacked",
       f"completed={_EMR}numCompletedTasks", f"failed={_EMR}numFailedTasks"),
    _p("emr", "recent_job_runs", "recent", "cluster=aws.emr.cluster_name",
       "application=aws.emr.application", "job=aws.emr.job.name", "state=aws.emr.job.run_state",
       "outcome=event.outcome", "duration=event.duration", n=100),
    _p("athena", "total_queries", "count"),
    _p("athena", "success_rate", "success_rate"),
    _p("athena", "avg_duration_s", "avg", DURATION, **SECONDS),
    _p("athena", "total_scanned_gb", "sum", "value=aws.athena.data_scanned_bytes", unit=GB),
    _p("athena", "query_outcomes", "share", by="event.outcome"),
    _p("athena", "queries_by_workgroup", "share", by="aws.athena.workgroup"),
    _p("athena", "queries_by_database", "share", by="aws.athena.database"),
    _p("athena", "query_volume", "count_line"),
    _p("athena", "engine_execution_time", "avg_line", f"value={_ATH}EngineExecutionTimeInMillis.avg"),
    _p("athena", "query_queue_time", "avg_line", f"value={_ATH}QueryQueueTimeInMillis.avg"),
    _p("athena", "query_planning_time", "avg_line", f"value={_ATH}QueryPlanningTimeInMillis.avg"),
    _p("athena", "scanned_by_workgroup_gb", "sum_by", "value=aws.athena.data_scanned_bytes",
       by="aws.athena.workgroup", unit=GB),
    _p("athena", "top_error_codes", "failures_by", by="aws.athena.error_code", n=10),
    _p("athena", "engine_version_split", "share", by="aws.athena.engine_version"),
    _p("athena", "recent_queries", "recent", "workgroup=aws.athena.workgroup",
       "database=aws.athena.database", "state=aws.athena.state", "duration=event.duration",
       "scanned_mb=aws.athena.data_scanned_mb", "error_code=aws.athena.error_code", n=100),
]

NUMERIC = {"duration", "scanned_mb", "records", "lag_ms", "checkpoint_ms", "kpu"}


def fields_of(panel: Panel) -> list[str]:
    names = [f for _, f in panel.series] + [f for f, _ in panel.where]
    return names + ([panel.by] if panel.by else [])


def run(panel: Panel, docs: DataFrame, span: str = "15 minutes", tie: str | None = None) -> DataFrame:
    """The panel's plan over documents of its dataset (column ``dataset``)."""
    df = docs.filter(F.col("dataset").isin(*DATASETS[panel.dashboard]))
    for name, value in panel.where:
        df = df.filter(pick(df, name) == value)
    outcome = pick(df, "event.outcome")

    def measure(field: str, agg) -> Column:
        return agg(pick(df, field, "double")) / F.lit(float(panel.unit))

    if panel.kind == "count":
        return A.total(df)
    if panel.kind == "failures":
        return A.failures(df, outcome)
    if panel.kind == "success_rate":
        return df.agg(A.success_rate(outcome).alias("value"))
    if panel.kind in ("avg", "sum"):
        agg = F.avg if panel.kind == "avg" else F.sum
        return df.agg(*[measure(f, agg).alias(n) for n, f in panel.series])
    if panel.kind == "count_line":
        return A.over_time(df, span, value=F.count("*"))
    if panel.kind == "failures_line":
        return A.over_time(df, span, value=F.count_if(outcome == A.FAILURE))
    if panel.kind in ("avg_line", "sum_line"):
        agg = F.avg if panel.kind == "avg_line" else F.sum
        return A.over_time(df, span, **{n: measure(f, agg) for n, f in panel.series})
    if panel.kind == "stacked":
        return A.stacked(df, span, **{n: measure(f, F.sum) for n, f in panel.series})
    if panel.kind == "recent":
        columns = [F.col("ts")] + [
            pick(df, f, "double" if n in NUMERIC else "string").alias(n) for n, f in panel.series
        ]
        return A.recent(df, columns, n=panel.n, ties=[tie] if tie else ())
    keyed = df.withColumn("key", pick(df, panel.by))
    if panel.kind == "share":
        return A.share_of(keyed, "key")
    if panel.kind == "top":
        return A.top(keyed, "key", panel.n)
    if panel.kind == "failures_by":
        return A.failures_by(keyed, outcome, "key", panel.n or None)
    if panel.kind == "avg_by":
        return keyed.groupBy("key").agg(*[measure(f, F.avg).alias(n) for n, f in panel.series])
    if panel.kind == "sum_by":
        return A.sum_by(keyed, "key", pick(df, panel.series[0][1], "double"), panel.unit)
    raise ValueError(f"unknown panel kind {panel.kind}")


def by_name(name: str) -> Panel:
    return next(p for p in PANELS if p.name == name)


def hot_fields(panels: list[Panel] | None = None) -> dict[str, str]:
    """The fields below ``aws`` that panels read, with their types, for ``fields.promote``."""
    out: dict[str, str] = {}
    for p in PANELS if panels is None else panels:
        for name, field in p.series:
            numeric = p.kind != "recent" or name in NUMERIC
            out[field] = "double" if numeric else out.get(field, "string")
        for field in [p.by, *[f for f, _ in p.where]]:
            if field:
                out[field] = "string"
    return {f: kind for f, kind in out.items() if f.startswith("aws.")}

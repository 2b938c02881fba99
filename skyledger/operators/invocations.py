"""The START, application, END and REPORT lines of one request as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.scalars import json_field
from skyledger.operators.joins import lookup_join


def request_id(message: Column) -> Column:
    """The request a line belongs to: system line, application line or JSON line."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(message, r"RequestId: (\S+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(message, r"^\[[A-Z]+\]\t([^\t]+)\t", 1), F.lit("")),
        json_field(message, "$.requestId"),
    )
    return found


def line_kind(message: Column) -> Column:
    """start, end, report or app."""
    kind = F.lit("app")
    for name in ("report", "end", "start"):
        kind = F.when(message.startswith(f"{name.upper()} RequestId:"), name).otherwise(kind)
    return kind


def lines(df: DataFrame, message: str = "message") -> DataFrame:
    """Lines with ``request_id``, ``line`` and the reported duration and memory."""
    text = F.col(message)
    number = lambda regex: F.nullif(F.regexp_extract(text, regex, 1), F.lit(""))
    return df.withColumns(
        {
            "request_id": request_id(text),
            "line": line_kind(text),
            "duration_ms": number(r"\tDuration: ([0-9.]+) ms").try_cast("double"),
            "memory_mb": number(r"Max Memory Used: ([0-9]+) MB").try_cast("bigint"),
        }
    ).filter(F.col("request_id").isNotNull())


def assembly(*extra: Column) -> list[Column]:
    """Aggregates that fold the lines of a request; they combine before the shuffle."""
    is_line = lambda name: F.col("line") == name
    return [
        F.min(F.when(is_line("start"), F.col("ts"))).alias("started"),
        F.max(F.when(is_line("end"), F.col("ts"))).alias("ended"),
        F.count_if(is_line("app")).alias("app_lines"),
        F.count_if(is_line("report")).alias("reports"),
        F.max("duration_ms").alias("duration_ms"),
        F.max("memory_mb").alias("memory_mb"),
        *extra,
    ]


def assemble(df: DataFrame, by: str = "request_id") -> DataFrame:
    """One row per request over a batch."""
    return lines(df).groupBy(by).agg(*assembly())


def sessions(df: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """The same for a stream; a request closes when it is silent for ``gap``.

    The input needs a watermark on ``ts`` when it is unbounded.
    """
    return (
        lines(df)
        .groupBy("request_id", F.session_window("ts", gap).alias("_w"))
        .agg(*assembly())
        .select(
            "request_id", F.col("_w.start").alias("opened"), F.col("_w.end").alias("closed"),
            "started", "ended", "app_lines", "reports", "duration_ms", "memory_mb",
        )
    )


def with_traces(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Log lines with the root span of the trace they name; lines without one are kept."""
    roots = spans.filter(F.col("parent_id").isNull()).groupBy("trace_id").agg(
        F.min("service_name").alias("root_service"), F.min("name").alias("root_name")
    )
    return lookup_join(logs, roots, ["trace_id"])

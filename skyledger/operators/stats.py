"""Aggregations behind dashboard panels: KPIs, shares, top lists, time series, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import scalars as X

SUCCESS, FAILURE = "success", "failure"


def bucket(ts: Column, span: str = "15 minutes") -> Column:
    """Start of the tumbling window a time falls into."""
    return F.window(ts, span).getField("start")


def total(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count("*").alias("value"))


def failures(df: DataFrame, outcome: Column) -> DataFrame:
    """A2."""
    return df.agg(F.count_if(outcome == FAILURE).alias("value"))


def success_rate(outcome: Column) -> Column:
    """A3: percentage of all rows; no rows give NULL."""
    return F.try_divide(F.lit(100.0) * F.count_if(outcome == SUCCESS), F.count("*"))


def avg_seconds(duration_ns: Column) -> Column:
    """A4."""
    return F.avg(X.ns_to_s(duration_ns))


def sum_in(value: Column, unit: float = 1.0) -> Column:
    """A5: sum after conversion, for instance bytes to GB."""
    return F.sum(value.cast("double")) / F.lit(float(unit))


def share_of(df: DataFrame, *by: str) -> DataFrame:
    """Count and share of the total per value.

    The total is a scalar subquery over the grouped rows, so no window pulls all groups into one
    task and the small aggregate is reused.
    """
    groups = df.groupBy(*by).agg(F.count("*").alias("count"))
    whole = groups.agg(F.sum("count")).scalar()
    return groups.select(*by, "count", (F.col("count") / whole).alias("share"))


def top(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Most frequent values, ties broken by the value itself."""
    return ranked(df.groupBy(by).agg(F.count("*").alias("count")), "count", [by]).limit(n)


def ranked(df: DataFrame, measure: str, ties: list[str]) -> DataFrame:
    """O1."""
    return df.orderBy(F.desc(measure), *ties)


def failures_by(df: DataFrame, outcome: Column, by: str, n: int | None = None) -> DataFrame:
    """Failed rows per value, optionally the top ``n``."""
    failed = df.filter(outcome == FAILURE)
    return top(failed, by, n) if n else failed.groupBy(by).agg(F.count("*").alias("count"))


def over_time(df: DataFrame, span: str, ts: str = "ts", **measures: Column) -> DataFrame:
    """One or several measures per time bucket."""
    return df.groupBy(bucket(F.col(ts), span).alias("bucket")).agg(
        *[m.alias(name) for name, m in measures.items()]
    )


def stacked(df: DataFrame, span: str, ts: str = "ts", **measures: Column) -> DataFrame:
    """Several sums per bucket in long form (bucket, series, value)."""
    wide = over_time(df, span, ts, **{k: v.cast("double") for k, v in measures.items()})
    return wide.unpivot("bucket", list(measures), "series", "value")


def sum_by(df: DataFrame, by: str, value: Column, unit: float = 1.0) -> DataFrame:
    """A12."""
    return df.groupBy(by).agg(sum_in(value, unit).alias("value"))


def stats_by(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Count and average per key, most frequent first."""
    stats = df.groupBy(*by).agg(F.count("*").alias("count"), F.avg(value).alias("avg"))
    return ranked(stats, "count", by)


def merge_stats(df: DataFrame, by: list) -> DataFrame:
    """Merge (sum, count, max, min) rows; the average is weighted by the counts."""
    return df.groupBy(*by).agg(
        F.sum("sum").alias("sum"),
        F.sum("count").alias("count"),
        F.max("max").alias("max"),
        F.min("min").alias("min"),
        F.try_divide(F.sum("sum"), F.sum("count")).alias("avg"),
    )


def first_seen(df: DataFrame, value: str, span: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """First time and number of distinct buckets per value.

    Rows collapse to one per (value, bucket) first, which also spreads a frequent value.
    """
    seen = df.groupBy(value, bucket(F.col(ts), span).alias("bucket")).agg(F.min(ts).alias("ts"))
    return seen.groupBy(value).agg(F.min("ts").alias("first_seen"), F.count("*").alias("buckets"))


def volume(df: DataFrame, dataset: str = "dataset", doc: Column | None = None) -> DataFrame:
    """Documents and bytes of JSON per dataset."""
    text = doc if doc is not None else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.groupBy(dataset).agg(
        F.count("*").alias("docs"), F.sum(F.octet_length(text)).alias("bytes")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; older ones are dropped before the shuffle already."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def recent(df: DataFrame, columns: list[Column], ts: str = "ts", n: int = 100, ties=()) -> DataFrame:
    """O2: the newest ``n`` events; a distributed top-n, not a full sort."""
    return df.orderBy(F.desc(ts), *ties).limit(n).select(*columns)


def timeline(*frames: DataFrame) -> DataFrame:
    """Several signals as one event table."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def id_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Ids that are missing or unexpected.

    Both sides meet in one aggregation instead of two anti joins, so an id that fills a large
    part of a table collapses before the only shuffle.
    """
    want = expected.select(key, F.lit(1).alias("_want"), F.lit(0).alias("_have"))
    have = observed.select(key, F.lit(0).alias("_want"), F.lit(1).alias("_have"))
    sides = (
        want.unionByName(have)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("_want").alias("_want"), F.max("_have").alias("_have"))
    )
    status = F.when(F.col("_have") == 0, "missing").when(F.col("_want") == 0, "unexpected")
    return sides.select(key, status.alias("status")).filter(F.col("status").isNotNull())

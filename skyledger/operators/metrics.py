"""Metric documents as long rows; rollups, pivots, dedup, ratios, accept window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.stats import bucket, merge_stats
from skyledger.sources.sinks import Rule, first_per_key, quarantine

ACCEPT_WINDOW = "2 hours"
TAIL = "map<string,variant>"


def explode_metrics(docs: DataFrame) -> DataFrame:
    """M1: one row per metric of a document.

    ``aws`` is a VARIANT ``{service: {metrics: {name: {avg, sum, ...}}, dimensions: {...}}}``.
    Casting an object to a map keeps keys with dots and spaces whole, which paths would not.
    Dimensions sit below the service or directly below ``aws``.
    """
    base = [c for c in docs.columns if c != "aws"]
    outer = F.try_variant_get("aws", "$.dimensions", "map<string,string>")
    services = docs.select(
        *base, outer.alias("_dims"), F.explode(F.try_variant_get("aws", "$", TAIL)).alias("_s", "_v")
    )
    metrics = services.select(
        *base,
        F.coalesce(
            F.try_variant_get("_v", "$.dimensions", "map<string,string>"), F.col("_dims")
        ).alias("dimensions"),
        F.explode(F.try_variant_get("_v", "$.metrics", TAIL)).alias("metric", "_m"),
    )
    stat = lambda name, kind: F.try_variant_get("_m", f"$.{name}", kind).alias(name)
    return metrics.select(
        *base, "dimensions", "metric",
        stat("avg", "double"), stat("sum", "double"), stat("count", "bigint"),
        stat("max", "double"), stat("min", "double"),
    )


def dimension_key(dimensions: Column) -> Column:
    """A comparable form of a dimension map: JSON text of its entries in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dimensions))))


# What a metric is besides its dimensions: the same name in another account or region is another one.
IDENTITY = ("dataset", "metric", "account_id", "region")


def rollup(
    df: DataFrame, span: str, keep: list[str] | None = None, by: tuple[str, ...] = IDENTITY
) -> DataFrame:
    """M2: coarser period and fewer dimensions, from stored sums and counts."""
    if keep is None:
        dims = [dimension_key(F.col("dimensions")).alias("dimension_key")]
    else:
        dims = [F.try_element_at("dimensions", F.lit(k)).alias(f"dim_{k}") for k in keep]
    slot = bucket(F.col("ts"), span).alias("bucket")
    return merge_stats(df, [*by, slot, *dims])


def by_dimension(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """M3: rows that carry a dimension (with a value, if given), and the value as a column."""
    out = df.withColumn(f"dim_{key}", F.try_element_at("dimensions", F.lit(key)))
    wanted = F.col(f"dim_{key}").isNotNull() if value is None else F.col(f"dim_{key}") == value
    return out.filter(wanted)


def to_wide(df: DataFrame, keys: list[str], metrics: list[str], stat: str = "avg") -> DataFrame:
    """M4: one column per metric. The list is given, so no extra pass looks for values."""
    return df.groupBy(*keys).pivot("metric", metrics).agg(F.max(stat))


def dedup(df: DataFrame, order: list[str]) -> DataFrame:
    """M5: first row per (dataset, metric, account, region, dimensions, time)."""
    keyed = df.withColumn("dimension_key", dimension_key(F.col("dimensions")))
    return first_per_key(keyed, [*IDENTITY, "dimension_key", "ts"], order)


def ratio(df: DataFrame, keys: list, numerator: str, denominator: str, stat: str = "sum") -> DataFrame:
    """M6: one metric over another per key; no denominator gives NULL."""
    pick = lambda name: F.sum(F.when(F.col("metric") == name, F.col(stat)))
    return df.groupBy(*keys).agg(
        pick(numerator).alias("numerator"),
        pick(denominator).alias("denominator"),
        F.try_divide(pick(numerator), pick(denominator)).alias("ratio"),
    )


def accept_window(ts: Column, now: Column, window: str = ACCEPT_WINDOW) -> Column:
    """M7: a time exactly as old as the window is still accepted."""
    return ts >= now - F.expr(f"INTERVAL {window}")


def split_late(df: DataFrame, now: Column, window: str = ACCEPT_WINDOW) -> tuple[DataFrame, DataFrame]:
    """M7 with S10: rows in time, and late rows put aside."""
    return quarantine(df, [Rule("timestamp_out_of_range", accept_window(F.col("ts"), now, window))])

"""A17 and A18 as sketches: small summaries per bucket that merge over time without raw rows.

Summaries are columns of ordinary tables: written once per bucket, then merged to hours, days or any
other grouping. KLL keeps quantiles (rank error about 1.3 % for k = 200, whatever the number of
rows or merges), HLL distinct counts (about 1.6 % standard error for 12 bits), theta sets that can
also be intersected (exact up to 2**lg entries, then about 1 / sqrt(2**lg)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.quantiles import label
from skyledger.operators.stats import bucket

KLL_K = 200
HLL_BITS = 12
THETA_BITS = 14


def quantile_sketches(
    df: DataFrame, keys: list[str], value: str, span: str = "15 minutes", ts: str = "ts", k: int = KLL_K
) -> DataFrame:
    """Keys, bucket, n and the sketch of the non-null values; a bucket without any has no row."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*keys, bucket(F.col(ts), span).alias("bucket")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    )


def merge_quantiles(sketches: DataFrame, by: list, k: int = KLL_K) -> DataFrame:
    """Sketches of any grouping, merged: partial merges combine before the shuffle."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def quantiles(sketches: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """``p50``, ``p95`` ... read out of sketches."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(label(p)) for p in probs]
    return sketches.select(*by, "n", *found)


def rank_of(sketch: str, value: Column) -> Column:
    """Share of the values up to ``value``."""
    return F.kll_sketch_get_rank_double(sketch, value)


def distinct_sketches(
    df: DataFrame, keys: list[str], value: str, span: str = "15 minutes", ts: str = "ts", bits: int = HLL_BITS
) -> DataFrame:
    """Keys, bucket and an HLL sketch of the values seen; NULL is no value."""
    return df.groupBy(*keys, bucket(F.col(ts), span).alias("bucket")).agg(
        F.hll_sketch_agg(value, F.lit(bits)).alias("sketch")
    )


def distinct_counts(sketches: DataFrame, by: list) -> DataFrame:
    """Distinct values over merged sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def set_sketches(
    df: DataFrame, keys: list[str], value: str, span: str = "1 day", ts: str = "ts", bits: int = THETA_BITS
) -> DataFrame:
    """Keys, bucket and a theta sketch of the values seen, which can be intersected."""
    return df.groupBy(*keys, bucket(F.col(ts), span).alias("bucket")).agg(
        F.theta_sketch_agg(value, F.lit(bits)).alias("sketch")
    )


def merge_sets(sketches: DataFrame, by: list, bits: int = THETA_BITS) -> DataFrame:
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(bits)).alias("sketch"))


def compare_sets(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Per key: values of both periods, how many came back, are new, and are gone."""
    both = old.select(*by, F.col("sketch").alias("_old")).join(
        new.select(*by, F.col("sketch").alias("_new")), by
    )
    size = F.theta_sketch_estimate
    return both.select(
        *by, size("_old").alias("before"), size("_new").alias("after"),
        size(F.theta_intersection("_old", "_new")).alias("returned"),
        size(F.theta_difference("_new", "_old")).alias("appeared"),
        size(F.theta_difference("_old", "_new")).alias("gone"),
    )

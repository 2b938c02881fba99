"""Latency percentiles per group, approximate and exact."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import stage


def approx_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Bounded sketches that combine before the shuffle; ``p50``, ``p95`` ... per group."""
    quantiles = F.percentile_approx(value, [float(p) for p in probs], accuracy)
    out = df.groupBy(*keys).agg(quantiles.alias("_q"))
    return out.select(*keys, *[F.get("_q", F.lit(i)).alias(label(p)) for i, p in enumerate(probs)])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles without holding a large group in one task.

    1. Equal values collapse to (keys, value, count) rows, dealt by range of (keys, value) and staged:
       the input is read once, and a group with many values spans many partitions.
    2. Counts per (keys, partition) give the rank at which each part of a group begins.
    3. Only the parts that hold a wanted rank are ranked row by row, each by itself.

    Rows with a NULL key form groups like any others.
    """
    order = [*keys, value]
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*order).agg(F.count("*").alias("_c"))
    )
    parts = stage(
        counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "percentiles"
    )
    sizes = parts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_in_part"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.withColumns(
        {
            "_n": F.sum("_in_part").over(group),
            "_before": F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)),
        }
    )

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = [r for p in probs for r in _ranks(p)]
    target = spans.filter(
        reduce(or_, [holds(r, F.col("_before"), F.col("_in_part")) for r in wanted])
    )
    same = reduce(and_, [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_part"]])
    near = (
        parts.alias("p")
        .join(target.alias("t"), same)
        .select(*[F.col(f"p.{c}") for c in parts.columns], "t._n", "t._before")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    start = F.col("_before") + F.coalesce(
        F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ranked = near.withColumn("_start", start)
    picks = []
    for i, p in enumerate(probs):
        for side, rank in zip("lh", _ranks(p), strict=True):
            hit = F.when(holds(rank, F.col("_start"), F.col("_c")), F.col(value))
            picks.append(F.max(hit).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(label(p)))
    return found.select(*keys, *out)


def label(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def _ranks(p: float) -> tuple[Column, Column]:
    position = F.lit(float(p)) * (F.col("_n") - 1)
    return F.floor(position), F.ceil(position)

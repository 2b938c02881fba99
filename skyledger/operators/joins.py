"""Outer joins that stay balanced when one key holds a large part of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from skyledger.session import stage


def has_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], spread: int = 1024) -> DataFrame:
    """Left outer join against a side with one row per key.

    A busy key can only sit on the left, which adaptive execution splits. Rows without a key
    match nothing, but would all hash to one task; a salt taken from their other columns
    spreads them. The salt of the right side is always 0, written so that the optimizer does
    not fold it and drop it from the join keys.
    """
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, AtomicType)
             and not isinstance(f.dataType, VariantType)]
    anywhere = F.pmod(F.xxhash64(*plain), F.lit(spread)) + 1
    salted = left.withColumn("_salt", F.when(has_key(keys), F.lit(0)).otherwise(anywhere))
    looked_up = right.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(1)))
    return salted.join(looked_up, [*keys, "_salt"], "left").drop("_salt")


def expand_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer join against a side with many rows per key.

    An outer join cannot split a busy key on its optional side. An inner join can, on either
    side, so the matches come from an inner join and the rest from an anti join on the distinct
    keys, in which every key is one row.
    """
    matched = left.join(right, keys)
    bare = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], before_seconds: float, after_seconds: float,
    ts: str = "ts", other: str = "at", most: int = 100_000,
) -> DataFrame:
    """Pairs of equal keys whose ``other`` time lies from ``before_seconds`` before ``ts`` to
    ``after_seconds`` after it, both ends included, to the microsecond.

    Both sides are cut into time chunks as long as the interval; a left row is handed to the chunks that
    its interval touches, so the join is an equi-join however long the tables reach. Where a chunk of a
    key still has more than ``most`` rows on a side, that side is dealt over several parts and the
    other side is given to each, so that no task holds a busy key. Rows without a key or time meet
    nothing.
    """
    before, after = round(before_seconds * 1_000_000), round(after_seconds * 1_000_000)
    width = max(before + after, 1)
    chunk = lambda at: F.floor(at / width).cast("bigint")
    at = F.unix_micros(ts)
    asking = left.filter(has_key(keys) & F.col(ts).isNotNull()).withColumn(
        "_chunk", F.explode(F.sequence(chunk(at - before), chunk(at + after)))
    )
    there = right.filter(has_key(keys) & F.col(other).isNotNull()).withColumn("_chunk", chunk(F.unix_micros(other)))
    part = [*keys, "_chunk"]

    def sizes(df: DataFrame, name: str) -> DataFrame:
        parts = F.ceil(F.count("*") / most).cast("int").alias(name)
        return df.groupBy(*part).agg(parts).filter(F.col(name) > 1)

    busy = stage(sizes(asking, "_l").join(sizes(there, "_r"), part, "full"), "busy-chunks")

    def dealt(df: DataFrame, mine: str, others: str) -> DataFrame:
        one = F.lit(1)
        plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)
                 and not isinstance(f.dataType, VariantType)]
        own = F.pmod(F.xxhash64(*plain), F.coalesce(mine, one)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(others, one) - 1))
        return df.join(busy, part, "left").withColumn(f"{mine}_", own).withColumn(f"{others}_", every).drop(mine, others)

    pairs = dealt(asking, "_l", "_r").join(dealt(there, "_r", "_l"), [*part, "_l_", "_r_"])
    offset = F.unix_micros(other) - F.unix_micros(ts)
    return pairs.filter((offset >= -before) & (offset <= after)).drop("_chunk", "_l_", "_r_")

"""Filters F1-F5 (F3 lives with the registry)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fields import pick


def where_equal(df: DataFrame, **values: Any) -> DataFrame:
    """conjunctive equality, ``where_equal(df, event__outcome="failure")``."""
    for name, value in values.items():
        df = df.filter(pick(df, name.replace("__", ".")) == F.lit(value))
    return df


def min_score(df: DataFrame, score: float = 50.0, column: str = "score") -> DataFrame:
    """F2."""
    return df.filter(F.col(column) >= score)


# What a valid prefix looks like, and how it must not begin or end.
PREFIX, BAD_START, BAD_END = "^[a-zA-Z0-9_-]{1,80}$", "^[-_]", "[-_]$"


def valid_prefix(name: Column) -> Column:
    """1-80 letters, digits, hyphens and underscores, not starting or ending with - or _."""
    text = F.trim(name)
    return F.coalesce(
        text.rlike(PREFIX) & ~text.rlike(BAD_START) & ~text.rlike(BAD_END), F.lit(False)
    )


def time_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Half-open range; with a ``date`` partition column the scan is pruned as well."""
    if "date" in df.columns:
        df = df.filter((F.col("date") >= start.cast("date")) & (F.col("date") <= end.cast("date")))
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))

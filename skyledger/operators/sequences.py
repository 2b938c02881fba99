"""Order within a key: runs of equal symbols and what follows them, with no task that holds a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import stage


def chunked(df: DataFrame, chunk_seconds: int, ts: str = "ts") -> DataFrame:
    """``_at`` in microseconds and the time chunk ``_chunk``; rows without a time have no place."""
    return df.filter(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(ts)).withColumn(
        "_chunk", F.floor(F.col("_at") / (chunk_seconds * 1_000_000)).cast("bigint")
    )


def runs(
    df: DataFrame, keys: list[str], symbol: str = "symbol", ts: str = "ts", tie: str = "id",
    chunk_seconds: int = 3600,
) -> DataFrame:
    """One row per run of rows with the same symbol that follow each other within a key.

    Columns: keys, symbol, rows, begin_at, begin_id, end_at, end_id, next_symbol, next_at, next_id (the
    first row of the run behind it). Rows are ordered by (ts, tie), ties that are equal in both by nothing
    further. A pattern such as ``A+ B`` is a filter on symbol, rows and next_symbol.

    A busy key is cut into time chunks, in which runs are found by themselves. Only the first and the
    last run of a chunk can go on in a neighbouring one, so just these, two rows a chunk, are looked at
    per key. Rows without a time or symbol are left out.
    """
    part = [*keys, "_chunk"]
    near = Window.partitionBy(*part).orderBy("_at", tie)
    rows = chunked(df.filter(F.col(symbol).isNotNull()), chunk_seconds, ts).withColumn(
        "_new", F.when(F.lag(symbol).over(near) == F.col(symbol), 0).otherwise(1)
    )
    numbered = rows.withColumn("_run", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("_at", F.col(tie).alias("id"))
    local = numbered.groupBy(*part, "_run", F.col(symbol).alias("symbol")).agg(
        F.count("*").alias("rows"), F.min(place).alias("begin"), F.max(place).alias("end")
    )
    follow = Window.partitionBy(*part).orderBy("_run")
    local = stage(
        local.withColumn("next", F.lead(F.struct("symbol", "begin")).over(follow)).withColumn(
            "_edge", (F.col("_run") == 1) | F.col("next").isNull()
        ),
        "runs",
    )
    order = Window.partitionBy(*keys).orderBy("_chunk", "_run")
    before = F.lag(F.struct("_chunk", "symbol")).over(order)
    goes_on = (before["_chunk"] < F.col("_chunk")) & (before["symbol"] == F.col("symbol"))
    edges = local.filter("_edge").withColumns(
        {
            "_new": F.when(goes_on, 0).otherwise(1),
            "next": F.coalesce("next", F.lead(F.struct("symbol", "begin")).over(order)),
        }
    )
    edges = edges.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_island").agg(
        F.first("symbol").alias("symbol"), F.sum("rows").alias("rows"), F.min("begin").alias("begin"),
        F.max("end").alias("end"), F.max_by("next", F.struct("_chunk", "_run")).alias("next"),
    )
    columns = [*keys, "symbol", "rows", "begin", "end", "next"]
    whole = local.filter(~F.col("_edge")).select(*columns).unionByName(joined.select(*columns))
    time = lambda c: F.timestamp_micros(F.col(c))
    return whole.select(
        *keys, "symbol", "rows", time("begin._at").alias("begin_at"), F.col("begin.id").alias("begin_id"),
        time("end._at").alias("end_at"), F.col("end.id").alias("end_id"),
        F.col("next.symbol").alias("next_symbol"), time("next.begin._at").alias("next_at"),
        F.col("next.begin.id").alias("next_id"),
    )


def next_match(
    df: DataFrame, keys: list[str], match: str, name: str, ts: str = "ts", tie: str = "id",
    chunk_seconds: int = 3600,
) -> DataFrame:
    """``df`` with the place (struct of time in microseconds and tie) of the first later row of the key for
    which the boolean column ``match`` holds. Rows without a time are left out.

    Within a time chunk it is a frame, beyond it the first match of a later chunk, from one row a chunk.
    """
    part = [*keys, "_chunk"]
    place = F.when(F.col(match), F.struct("_at", F.col(tie).alias("id")))
    rows = chunked(df, chunk_seconds, ts)
    firsts = rows.groupBy(*part).agg(F.min(place).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select(*part, F.min("_first").over(later).alias("_carry"))
    after = Window.partitionBy(*part).orderBy("_at", tie).rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("_near", F.min(place).over(after))
    return near.join(carried, part, "left").withColumn(name, F.coalesce("_near", "_carry")).select(
        *df.columns, name
    )

"""Writing documents: data streams, bulk lines, create-only appends, outcomes, quarantine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default number of documents per bulk batch.
BATCH_DOCS = 250

# Fixed value: error type that means "already there", not a failure.
CONFLICT = "version_conflict_engine_exception"

STREAM_KEYS = ("type", "dataset", "namespace", "date")


def write_data_stream(
    df: DataFrame, root: str, mode: str = "append", max_records: int | None = None
) -> None:
    """Documents to ``type/dataset/namespace/date`` folders.

    ``df`` carries ``stream_type``, ``stream_dataset``, ``stream_namespace`` and ``ts``. The
    rebalance hint lets adaptive execution split a dataset that holds most of the rows over many
    tasks and join tiny datasets into one task, instead of one writer per dataset.
    """
    out = (
        df.withColumnRenamed("stream_type", "type")
        .withColumnRenamed("stream_dataset", "dataset")
        .withColumnRenamed("stream_namespace", "namespace")
        .withColumn("date", F.to_date("ts"))
        .hint("rebalance", *STREAM_KEYS)
    )
    writer = out.write.mode(mode).partitionBy(*STREAM_KEYS)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(root)


def bulk_lines(df: DataFrame, index: Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row per document holding the action line and the document line."""
    action = F.to_json(F.struct(F.struct(index.alias("_index")).alias("create")))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in exclude]))
    return df.select(F.concat_ws("\n", action, body).alias("value"))


def write_bulk_ndjson(
    df: DataFrame, index: Column, path: str, batch: int = BATCH_DOCS, exclude: tuple[str, ...] = ()
) -> None:
    """Newline-delimited bulk files of at most ``batch`` documents each."""
    bulk_lines(df, index, exclude).write.option("maxRecordsPerFile", batch).text(path)


def append_create_only(
    df: DataFrame, existing: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """The rows whose key is new; a repeated key keeps its first row by ``order``.

    Duplicates collapse in a partial aggregate before the shuffle, so many copies of one key
    cost one row per map task. A missing key part equals a missing key part.
    """
    fresh, known = first_per_key(df, keys, order).alias("f"), existing.select(*keys).alias("e")
    same = reduce(and_, [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    return fresh.join(known, same, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; other copies are dropped before the shuffle already."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


class CreateOnlyTable:
    """S8 and J8 for a large stored table: an append reads only what could clash with it.

    Rows are stored in buckets by a digest of their key and in folders by date. As the time is part of
    the key, a batch can only clash with rows of its own dates; and as batch and table are cut alike by
    the digest, the stored side is never shuffled. ``keys`` must include ``ts``. Each append is a batch
    of its own; concurrent appends need an order from outside.
    """

    DIGEST, DATE = "_key", "_date"

    def __init__(self, name: str, keys: list[str], buckets: int = 64, ts: str = "ts", path: str | None = None):
        if ts not in keys:
            raise ValueError(f"the key has to include the time {ts}")
        self.name, self.keys, self.buckets, self.ts, self.path = name, keys, buckets, ts, path

    def _stored_as(self, df: DataFrame) -> DataFrame:
        part = lambda k: F.coalesce(F.concat(F.lit("v"), F.col(f"`{k}`").cast("string")), F.lit("n"))
        sized = [F.concat_ws(":", F.length(part(k)).cast("string"), part(k)) for k in self.keys]
        return df.withColumns(
            {self.DIGEST: F.sha2(F.concat(*sized), 256), self.DATE: F.to_date(F.col(self.ts).cast("timestamp"))}
        )

    def _write(self, df: DataFrame) -> None:
        writer = df.write.mode("append").format("parquet").partitionBy(self.DATE)
        writer = writer.bucketBy(self.buckets, self.DIGEST).sortBy(self.DIGEST)
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def fresh(self, df: DataFrame, order: list[str]) -> DataFrame:
        """The rows of ``df`` whose key is new, one per key."""
        spark = df.sparkSession
        first = self._stored_as(first_per_key(df, self.keys, order))
        if not spark.catalog.tableExists(self.name):
            return first
        # one row a date: a batch has few, and they prune the folders of the table
        dates = [r[0] for r in df.select(F.to_date(F.col(self.ts).cast("timestamp"))).distinct().collect()]
        known = F.col(self.DATE).isin(*[d for d in dates if d is not None])
        known = known | F.col(self.DATE).isNull() if None in dates else known
        stored = spark.table(self.name).filter(known).select(self.DIGEST)
        return first.repartition(self.buckets, self.DIGEST).join(stored, self.DIGEST, "left_anti")

    def append(self, df: DataFrame, order: list[str]) -> None:
        """Stores the rows whose key is new; a repeated key keeps its first row by ``order``."""
        self._write(self.fresh(df, order))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop(self.DIGEST, self.DATE)


def ingest_outcomes(df: DataFrame, dataset: str = "dataset", seq: str = "seq") -> DataFrame:
    """Indexed, conflict and failed counts per dataset, with the first real error."""
    kind = F.col("error_type")
    conflict = F.coalesce(kind == CONFLICT, F.lit(False))
    failed = kind.isNotNull() & ~conflict
    first = F.min_by(
        F.struct("error_type", "error_reason"), F.when(failed, F.col(seq))
    )
    return (
        df.groupBy(dataset)
        .agg(
            F.count_if(kind.isNull()).alias("indexed"),
            F.count_if(conflict).alias("conflict"),
            F.count_if(failed).alias("failed"),
            first.alias("_first"),
        )
        .select(
            dataset, "indexed", "conflict", "failed",
            F.col("_first.error_type").alias("first_error_type"),
            F.col("_first.error_reason").alias("first_error_reason"),
        )
    )


@dataclass(frozen=True)
class Rule:
    """A named check; ``ok`` is the condition a good row meets."""

    name: str
    ok: Column


def tag_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``error_type``: the name of the first rule a row breaks, NULL for good rows."""
    broken = [F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]
    return df.withColumn("error_type", F.coalesce(*broken))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows to put aside, two filters over one tagged DataFrame."""
    tagged = tag_errors(df, rules)
    good = tagged.filter(F.col("error_type").isNull()).drop("error_type")
    return good, tagged.filter(F.col("error_type").isNotNull())

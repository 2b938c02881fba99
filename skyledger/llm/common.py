"""Helpers shared by the operators: bounded training samples and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import stage



def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name, that no column of ``docs`` has in any spelling."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` staged with a key per row, and the name of that column; ids may be null or repeated.

    The key is written with the rows: whoever reads them again sees the same key. These are copies of
    whole texts, so they are compressed harder than other tables.
    """
    row = free_name(docs, "__row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), label, compression="zstd"), row


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    digits = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(digits.cast("binary")), F.lit(modulus))


def share_of(doc_id: Column, seed: int) -> Column:
    """A reproducible position in [0, 1) for an id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: int = 7
) -> tuple[DataFrame, dict]:
    """About ``per_class`` documents of each label value that training may see, whole texts.

    Returns (doc_id, text, y) and the weight of a sampled row per label value, so that a model fitted
    on the balanced sample still knows the real shares. ``learn`` is a condition on ``doc_id``.
    Rows are chosen by a hash of the id: a rerun sees the same rows. A doc_id labelled more than once
    counts as its largest label; null labels are no labels. The ids of the sample are broadcast:
    they are bounded by the parameter, whatever the input.
    """
    known = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take, weight = F.lit(False), {}
    for value, n in counts.items():
        rate = min(1.0, per_class / n)
        weight[value] = 1.0 / rate
        take = take | ((F.col("y") == value) & (share_of(F.col("doc_id"), seed) < rate))
    sample = docs.select("doc_id", "text").join(F.broadcast(known.where(take)), "doc_id")
    return sample, weight


def over_batches(
    df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], list]], schema: str
) -> DataFrame:
    """``df`` mapped batch by batch. ``build`` runs once a task and returns the function.

    That function turns a record batch into the columns of ``schema``, in order.
    """
    spark = df.sparkSession
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, type=t)
                        for c, t in zip(columns, arrow.types, strict=True)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


class Memo(dict):
    """``memo[key]`` computes a value once; forgets everything when it holds ``limit`` entries.

    Text repeats its words: a bounded memo makes the cost that of a dictionary look-up. What is
    forgotten is computed again, so the limit bounds memory and changes no result.
    """

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

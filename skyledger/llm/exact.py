"""Exact dedup by sorting content: equal texts become neighbours and are compared in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import _arrow_schema, keyed
from skyledger.session import stage

RUNS = (
    "doc_id long, row long, text_sha256 string, part int, first_key boolean, last_key boolean, "
    "local_size long, local_keep long, local_row long"
)


def mark_copies(
    docs: DataFrame, normalised: Column | None = None, keep: str = "largest", head: int = 64
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their ``normalised`` forms are identical; by default the text itself, null as
    the empty text. Of equal texts the row with the ``keep`` ("smallest" or "largest") doc_id stays.
    Rows that repeat a doc_id are rows of their own and share the flag of that id.
    """
    row = F.monotonically_increasing_id()  # only spreads rows that are equal in text and id
    return _marks(docs, row, normalised, keep, head).drop("row", "keep_row")


def _marks(
    docs: DataFrame, row: Column, normalised: Column | None = None, keep: str = "largest", head: int = 64
) -> DataFrame:
    """The columns of ``mark_copies``, the row key and ``keep_row``: the one row of the group that stays,
    of equal ids the one with the smallest key.

    The sort key is (first ``head`` characters, 64-bit hash, whole text, doc_id). Spark's range
    partitioner samples splitters of (head, hash, doc_id, row key), which stay short for any text, so the
    copies of one text, with one id or many, may span many partitions, each sorted externally. Neighbours
    are compared in full
    inside a partition. Runs that touch a partition's first or last key may go on next door: their
    sizes are summed by digest over one summary row a partition and run, a table bounded by the
    number of partitions, which is broadcast. No task ever holds a group of copies.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(normalised if normalised is not None else F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), text.alias("text"))
    sized = texts.select(
        "doc_id",
        "row",
        "text",
        F.left(F.col("text"), F.lit(head)).alias("key_head"),
        F.xxhash64("text").alias("key_hash"),
    )
    order = ["key_head", "key_hash", "text", "doc_id"]
    parts = sized.repartitionByRange("key_head", "key_hash", "doc_id", "row").sortWithinPartitions(*order)
    hashed = parts.withColumn("sha", F.sha2("text", 256))
    runs = stage(
        hashed.withColumn("part", F.spark_partition_id()).mapInArrow(_runs(keep), RUNS), "exact-runs"
    )

    at_edge = F.col("first_key") | F.col("last_key")
    rank = F.col("local_keep") if keep == "smallest" else F.bitwise_not("local_keep")  # reverses the order
    best = F.struct(
        F.col("local_keep").isNull().alias("absent"), rank.alias("rank"), "local_row", "local_keep"
    )
    edges = (
        runs.where(at_edge)
        .groupBy("part", "text_sha256")
        .agg(F.first("local_size").alias("n"), F.min(best).alias("k"))
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("edge_size"), F.min("k").alias("k"))
        .select("text_sha256", "edge_size", F.col("k.local_keep").alias("edge_keep"),
                F.col("k.local_row").alias("edge_row"))
    )
    inner = runs.where(~at_edge).select(
        "doc_id", F.col("local_keep").alias("keep_id"), F.col("local_size").alias("group_size"),
        "text_sha256", "row", F.col("local_row").alias("keep_row"),
    )
    outer = (
        runs.where(at_edge)
        .join(F.broadcast(edges), "text_sha256")
        .select("doc_id", F.col("edge_keep").alias("keep_id"), F.col("edge_size").alias("group_size"),
                "text_sha256", "row", F.col("edge_row").alias("keep_row"))
    )
    return inner.unionByName(outer).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        "row", "keep_row",
    )


def _runs(keep: str):
    """Rows of sorted partitions with the size and chosen id of their run of equal texts."""
    arrow = _arrow_schema(None, RUNS)
    choose = np.minimum if keep == "smallest" else np.maximum
    limits = np.iinfo(np.int64)
    absent = limits.max if keep == "smallest" else limits.min  # a null id is never chosen

    def finish(rows: pa.RecordBatch, starts: np.ndarray, first: np.ndarray, last: bool):
        """Runs that are complete: ``starts`` are their first rows, ``first`` marks the first key."""
        ids = pc.fill_null(rows.column("doc_id"), absent).to_numpy()
        sizes = np.diff(np.append(starts, len(ids)))
        chosen = np.repeat(choose.reduceat(ids, starts), sizes)
        able = np.where(ids == chosen, rows.column("row").to_numpy(), limits.max)
        chosen_row = np.repeat(np.minimum.reduceat(able, starts), sizes)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"), rows.column("row"), rows.column("sha").cast(pa.string()),
                rows.column("part"),
                pa.array(first), pa.array(np.full(len(ids), last)),
                pa.array(np.repeat(sizes, sizes).astype(np.int64)),
                pa.array(chosen, mask=chosen == absent), pa.array(chosen_row),
            ],
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that may go on in the next batch
        fresh: list[np.ndarray] = []  # whether each of them begins a run
        open_text, open_key, in_first = None, None, True

        def close(last: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return finish(rows, np.flatnonzero(np.concatenate(fresh)), np.full(len(rows), in_first), last)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, head, key = (batch.column(c) for c in ("text", "key_head", "key_hash"))
            new_run, new_key = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            for flags, columns in ((new_run, (text,)), (new_key, (head, key))):
                if n > 1:
                    flags[1:] = np.logical_or.reduce(
                        [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(False) for c in columns]
                    )
            if held:
                new_run[0] = open_text != text[0].as_py()
                new_key[0] = open_key != (head[0].as_py(), key[0].as_py())
            narrow = batch.select(["doc_id", "row", "sha", "part"])
            keys = np.flatnonzero(new_key)
            if held and (len(keys) == 0 or keys[0] > 0):
                until = int(keys[0]) if len(keys) else n
                held.append(narrow.slice(0, until))
                fresh.append(new_run[:until])
            if len(keys):
                if held:
                    yield close(last=False)
                    in_first = False
                begin, end = int(keys[0]), int(keys[-1])
                if end > begin:
                    first = np.zeros(end - begin, dtype=bool)
                    if in_first:
                        first[: int(keys[1]) - begin] = True
                        in_first = False
                    yield finish(
                        narrow.slice(begin, end - begin), np.flatnonzero(new_run[begin:end]), first, False
                    )
                held, fresh = [narrow.slice(end)], [new_run[end:]]
            open_text, open_key = text[n - 1].as_py(), (head[n - 1].as_py(), key[n - 1].as_py())
        if held:
            yield close(last=True)

    return run


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, with the ``keep`` doc_id; all columns stay.

    Rows go by the row key of a staged copy, so null and repeated ids lose no text and keep no copy. An
    id that isn't null is kept before a null one, and of equal ids the smallest row key.
    """
    rows, row = keyed(docs, "exact-rows")
    marks = _marks(rows, F.col(row), keep=keep)
    dropped = marks.where("row <> keep_row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").drop(row)

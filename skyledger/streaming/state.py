"""Keyed state of a stream as a log of Parquet segments that merge as they grow old.

Every micro-batch appends only the rows of the keys it touched. Segments of ``FAN`` batches merge into
one of the next level, ``FAN`` of those into one above, and so on, so that a row is written about
log(batches) times in all, and a reader finds the state before batch b in the segments that the digits
of b in base ``FAN`` name. No list of segments is kept anywhere: a replayed batch writes the same
folders again, and a folder that ought to be there and is not is an error, not an empty state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
SHARDS = 16
SHARD = "shard"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Log:
    """Segments below ``root``; ``merge`` reduces the rows of a key to those that still matter.

    ``merge`` must give the same result however the rows were merged before. Rows are hashed by ``keys``
    into ``SHARDS`` shards, in which merged segments are laid out, so that a reader who knows its keys
    opens only their shards. ``snapshot`` names state from before the first batch.
    """

    def __init__(
        self, root: str, layout: str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
        snapshot: str | None = None, fan: int = FAN,
    ):
        self.root, self.layout, self.keys, self.merge = root, layout, keys, merge
        self.snapshot, self.fan = snapshot, fan

    def path(self, level: int, last: int) -> str:
        return f"{self.root}/level={level}/upto={last}"

    def cover(self, batch_id: int) -> list[tuple[int, int]]:
        """(level, last batch) of the segments that hold everything before a batch."""
        out, done = [], 0
        level = 0
        while self.fan ** (level + 1) <= batch_id:
            level += 1
        while done < batch_id:
            size = self.fan**level
            if done + size <= batch_id:
                done += size
                out.append((level, done - 1))
            else:
                level -= 1
        return out

    def sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SHARD, F.pmod(F.xxhash64(*self.keys), F.lit(SHARDS)).cast("int"))

    def _read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(f"{self.layout}, {SHARD} INT").parquet(path)

    def read(self, spark: SparkSession, batch_id: int, shards: list[int] | None = None) -> DataFrame:
        """All rows before a batch, as often as segments hold some of a key; of some shards only, if named."""
        paths = [self.path(*segment) for segment in self.cover(batch_id)]
        paths += [self.snapshot] if self.snapshot else []
        if not paths:
            return spark.createDataFrame([], self.layout)
        rows = reduce(DataFrame.unionByName, [self._read(spark, p) for p in paths])
        if shards is not None:
            rows = rows.filter(F.col(SHARD).isin(*shards) if shards else F.lit(False))
        return rows.drop(SHARD)

    def touched(self, keys: DataFrame) -> list[int]:
        """The shards of some keys: at most ``SHARDS`` numbers, however many keys."""
        return sorted(r[0] for r in self.sharded(keys).select(SHARD).distinct().collect())

    def append(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Adds the rows of a batch, merges what is due, and gives the rows as they were stored."""
        spark, path = df.sparkSession, self.path(0, batch_id)
        self.sharded(df).write.mode("overwrite").parquet(path)
        level, count = 1, batch_id + 1
        while count % self.fan**level == 0:
            below = self.fan ** (level - 1)
            parts = [self.path(level - 1, batch_id - i * below) for i in range(self.fan)]
            rows = reduce(DataFrame.unionByName, [self._read(spark, p) for p in parts]).drop(SHARD)
            self.write(rows, self.path(level, batch_id))
            level += 1
        return self._read(spark, path).drop(SHARD)

    def write(self, rows: DataFrame, path: str) -> None:
        """A merged segment, one folder a shard."""
        merged = self.sharded(self.merge(rows)).repartition(SHARD)
        merged.write.mode("overwrite").partitionBy(SHARD).parquet(path)

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes the segments that merged in the batch before; a replay of ``batch_id`` needs none."""
        level = 1
        while batch_id and batch_id % self.fan**level == 0:
            below = self.fan ** (level - 1)
            for i in range(self.fan):
                remove(spark, self.path(level - 1, batch_id - 1 - i * below))
            level += 1

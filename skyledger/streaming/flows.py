"""Structured Streaming forms of the batch operators.

Every flow takes an unbounded DataFrame and reuses the batch plan. State is bounded by a
watermark, checkpoints go to the shared folder, and writers that need more than one output use
``foreachBatch`` with one folder per batch id, so that a replayed batch overwrites itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger.operators import detect as D
from skyledger.operators import invocations, security
from skyledger.operators.metrics import ACCEPT_WINDOW, accept_window
from skyledger.session import scratch_path
from skyledger.streaming.state import Log, remove


def with_delay(df: DataFrame, delay: str = D.QUERY_DELAY, ts: str = "ts") -> DataFrame:
    """The query delay of a datafeed as a watermark."""
    return df.withWatermark(ts, delay)


def bucket_stream(
    docs: DataFrame, jobs: list[D.Job], span: str | None = None, delay: str = D.QUERY_DELAY
) -> DataFrame:
    """Closed buckets of all jobs, each emitted once.

    Jobs have buckets of their own ``span``, unless one is given for all; every span is an aggregation
    of its own with one watermark.
    """
    if span is not None:
        return D.bucketise(with_delay(D.datafeed(docs, jobs), delay), span)
    parts = [bucket_stream(docs, mine, span, delay) for span, mine in D.by_span(jobs).items()]
    return reduce(DataFrame.unionByName, parts)


def split_late(df: DataFrame, arrival: Column, window: str = ACCEPT_WINDOW):
    """Z3: rows within the accept window of their arrival, and rows that came too late."""
    in_time = F.coalesce(accept_window(F.col("ts"), arrival, window), F.lit(False))
    return df.filter(in_time), df.filter(~in_time)


def write_split(
    df: DataFrame, arrival: Column, good: str, late: str, checkpoint: str, window: str = ACCEPT_WINDOW
) -> StreamingQuery:
    """Z3: both parts of one stream, written per batch; the batch is read and parsed once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            kept, put_aside = split_late(batch, arrival, window)
            kept.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            put_aside.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        finally:
            batch.unpersist()

    return start(df.writeStream.foreachBatch(store), checkpoint)


def create_only(df: DataFrame, keys: list[str], window: str = ACCEPT_WINDOW) -> DataFrame:
    """The first row per key within the watermark; keys include the time."""
    return df.withWatermark("ts", window).dropDuplicatesWithinWatermark(keys)


def start(writer, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run to the end of what is there, or keep running."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_table(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Append results to a folder, optionally one per dataset."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return start(writer.partitionBy(*partition_by) if partition_by else writer, checkpoint)


def run_to_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    to_table(df, out, scratch_path(spark, label + "-state"), partition_by).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


class Detector:
    """Scores for every closed bucket, across micro-batches, equal to those of one batch.

    State is keyed by (job, entity) and kept in two logs (``streaming.state``): the newest ``HISTORY``
    filled buckets of every entity with the time of its first one, and for rare detectors how many
    buckets a value and its job have had. A batch reads the state of the entities it touches and writes
    only their rows; jobs for which silence is the anomaly read all their entities, since all of them get
    scores. The state is bounded by the number of entities, however long the stream runs and however
    seldom an entity has data. A replayed batch reads the same state and writes the same folders; a
    folder that is lost is an error. One ``root`` belongs to one stream checkpoint.

    ``backfill`` scores a stretch of history in one batch and leaves its state as a snapshot. A stream
    with ``resume=True`` begins from there and scores no bucket of the backfill again.
    """

    BUCKETS = (
        "job STRING, entity STRING, bucket TIMESTAMP, docs BIGINT, values BIGINT, total DOUBLE, peak DOUBLE"
    )
    HISTORY = f"{BUCKETS}, first_bucket TIMESTAMP"
    COUNTS = "job STRING, entity STRING, n BIGINT"
    MARKS = "job STRING, since TIMESTAMP"

    def __init__(self, jobs: list[D.Job], root: str, span: str | None = None, resume: bool = False, fan: int = 8):
        self.spans = {span: jobs} if span else D.by_span(jobs)
        self.jobs, self.root, self.resume = jobs, root, resume
        key = ["job", "entity"]
        snapshot = lambda name: f"{root}/snapshot/{name}" if resume else None
        self.history = Log(f"{root}/history", self.HISTORY, key, _newest, snapshot("history"), fan)
        self.rare = Log(f"{root}/rare", self.COUNTS, key, _summed, snapshot("rare"), fan)

    def _of(self, df: DataFrame, rare: bool, jobs: list[D.Job] | None = None) -> DataFrame:
        chosen = [j.key for j in (self.jobs if jobs is None else jobs) if (j.function == D.RARE) == rare]
        return df.filter(F.col("job").isin(*chosen) if chosen else F.lit(False))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in self.BUCKETS.split(", ")]
        path = f"{self.root}/buckets/batch={batch_id}"
        batch.select(*columns).write.mode("overwrite").parquet(path)
        fresh = spark.read.schema(self.BUCKETS).parquet(path)
        for log in (self.history, self.rare):
            log.forget(spark, batch_id)
        scores = self._scores(fresh, batch_id)
        scores.write.mode("overwrite").parquet(f"{self.root}/scores/batch={batch_id}")
        # buckets and marks of the last batch stay for its replay, older ones are not read again
        for name in ("buckets", "marks"):
            if batch_id > 1:
                remove(spark, f"{self.root}/{name}/batch={batch_id - 2}")

    def _scores(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        spark, parts = fresh.sparkSession, []
        # One row per job of the list: up to where the buckets of a job are scored already.
        marks = self._marks(spark, batch_id)
        if any(j.function != D.RARE for j in self.jobs):
            mine = self._of(fresh, rare=False).withColumn("first_bucket", F.col("bucket"))
            past = self._past(mine, batch_id)
            stored = self.history.append(mine, batch_id)
            recent = past.unionByName(stored).withColumn(
                "first_bucket", F.min("first_bucket").over(Window.partitionBy("job", "entity"))
            )
            recent = recent.join(F.broadcast(marks), "job", "left")
            for span, jobs in self.spans.items():
                if set(D.families(jobs)) - {D.RARE}:
                    own = self._of(recent, False, jobs)
                    parts.append(D.score_buckets(own, jobs, D.span_seconds(span)))
        if any(j.function == D.RARE for j in self.jobs):
            mine = self._of(fresh, rare=True)
            touched = mine.select("job", "entity").distinct()
            none = F.lit(None).cast("string")
            whole = mine.select("job", none.alias("entity")).distinct()
            keys = touched.unionByName(whole)
            earlier = self.rare.read(spark, batch_id, self.rare.touched(keys))
            same = (F.col("e.job") == F.col("k.job")) & F.col("e.entity").eqNullSafe(F.col("k.entity"))
            earlier = earlier.alias("e").join(keys.alias("k"), same, "left_semi")
            self.rare.append(_rare_counts(mine), batch_id)
            parts.append(D.score_rare(mine, self.jobs, _summed(earlier)))
        newest = fresh.groupBy("job").agg(F.max("bucket").alias("since"))
        path = f"{self.root}/marks/batch={batch_id}"
        marks.unionByName(newest).groupBy("job").agg(F.max("since").alias("since")).coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)
        fresh_only = F.col("since").isNull() | (F.col("bucket") > F.col("since"))
        scores = reduce(DataFrame.unionByName, parts)
        return scores.join(F.broadcast(marks), "job", "left").filter(fresh_only).drop("since")

    def _marks(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id:
            return spark.read.schema(self.MARKS).parquet(f"{self.root}/marks/batch={batch_id - 1}")
        if self.resume:
            return spark.read.schema(self.MARKS).parquet(f"{self.root}/snapshot/marks")
        return spark.createDataFrame([], self.MARKS)

    def _past(self, mine: DataFrame, batch_id: int) -> DataFrame:
        """The state of the entities of a batch, and of all entities of jobs that score silence."""
        spark = mine.sparkSession
        keys = mine.select("job", "entity").distinct()
        past = self.history.read(spark, batch_id, self.history.touched(keys)).join(
            keys, ["job", "entity"], "left_semi"
        )
        silent = [j.key for j in self.jobs if j.function in D.NEEDS_EMPTY]
        if not silent:
            return past
        every = self.history.read(spark, batch_id).filter(F.col("job").isin(*silent))
        return past.filter(~F.col("job").isin(*silent)).unionByName(every)

    def backfill(self, docs: DataFrame, until) -> DataFrame:
        """Scores of all buckets that end by ``until``, in one batch, and a snapshot for the stream.

        ``until`` must be the end of a bucket of every span; the stream then takes the documents from
        ``until`` on.
        """
        spark = docs.sparkSession
        for span in self.spans:
            if until.timestamp() % D.span_seconds(span):
                raise ValueError(f"{until} is not the end of a bucket of {span}")
        path = f"{self.root}/snapshot"
        past = docs.filter(F.col("ts") < F.lit(until))
        parts = [D.bucketise(D.datafeed(past, jobs), span) for span, jobs in self.spans.items()]
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{path}/buckets")
        buckets = spark.read.schema(self.BUCKETS).parquet(f"{path}/buckets")
        mine = self._of(buckets, rare=False).withColumn("first_bucket", F.col("bucket"))
        self.history.write(mine, f"{path}/history")
        self.rare.write(_rare_counts(self._of(buckets, rare=True)), f"{path}/rare")
        marks = buckets.groupBy("job").agg(F.max("bucket").alias("since"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks")
        scores = [
            D.score(buckets.filter(F.col("job").isin(*[j.key for j in jobs])), jobs, D.span_seconds(span))
            for span, jobs in self.spans.items()
        ]
        out = f"{self.root}/scores/batch=-1"
        reduce(DataFrame.unionByName, scores).write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)

    def start(self, buckets: DataFrame, checkpoint: str) -> StreamingQuery:
        return start(buckets.writeStream.foreachBatch(self.on_batch), checkpoint)

    def scores(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/scores").drop("batch")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest ``HISTORY`` filled buckets per entity, each with the time of the entity's first one."""
    entity = Window.partitionBy("job", "entity")
    rank = F.row_number().over(entity.orderBy(F.desc("bucket")))
    first = F.min("first_bucket").over(entity)
    return rows.withColumns({"first_bucket": first, "_age": rank}).filter(
        F.col("_age") <= D.HISTORY
    ).drop("_age")


def _rare_counts(buckets: DataFrame) -> DataFrame:
    """Buckets per value of a job, and per job in the row without an entity."""
    values = buckets.groupBy("job", "entity").agg(F.count("*").alias("n"))
    whole = buckets.groupBy("job").agg(F.count_distinct("bucket").alias("n"))
    return values.unionByName(whole.select("job", F.lit(None).cast("string").alias("entity"), "n"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job", "entity").agg(F.sum("n").alias("n"))


def finding_stream(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Findings of two streams by finding id, at most ``within`` apart.

    Both sides need a watermark on their time column (``ts`` and ``other_ts``); the id is unique
    per finding, so the join yields one row per match and state is dropped after the window.
    """
    gap = F.expr(f"INTERVAL {within}")
    other = right.withColumnRenamed(key, "_key")
    return left.join(
        other,
        (F.col(key) == F.col("_key"))
        & (F.col("other_ts") >= F.col("ts") - gap)
        & (F.col("other_ts") <= F.col("ts") + gap),
    ).drop("_key")


def chain_stream(calls: DataFrame, actor: list[str], window: str = "1 hour", delay: str = D.QUERY_DELAY):
    """Complete escalation chains per actor and closed window."""
    return security.chain_counts(with_delay(calls, delay), actor, window)


def invocation_stream(logs: DataFrame, gap: str = "5 minutes", delay: str = D.QUERY_DELAY):
    """One row per request once it has gone silent."""
    return invocations.sessions(with_delay(logs, delay), gap)

"""Streams over several files give what the batch gives on closed data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import detect as D
from skyledger.operators import invocations
from skyledger.streaming import flows as Z

T0 = dt.datetime(2024, 1, 1)
DDL = "ts timestamp, dataset string, user string, value double, tenth string"
JOBS = [
    D.Job("s", "errors", "err", "high_count", split=("user",)),
    D.Job("s", "slow", "req", "high_mean", "value", ("user",)),
    D.Job("s", "volume", "req", "low_count", split=("user",)),
    D.Job("s", "odd", "req", "rare", split=("user", "tenth")),
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Six files of two hours each, in time order."""
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("stream")
    for i in range(6):
        data = [
            (T0 + dt.timedelta(hours=2 * i, seconds=rng.uniform(0, 7200)),
             "err" if rng.random() < 0.3 else "req", f"u{rng.randrange(3)}", rng.gauss(10, 3),
             rng.choice(["a|b", "c", None, "", "\\N", "d", "e"]))
            for _ in range(300)
        ]
        if i == 4:
            data = [r for r in data if r[2] != "u1"]
        spark.createDataFrame(data, DDL).coalesce(1).write.parquet(f"{root}/p{i}")
    return str(root)


def source(spark, parts, fmt="parquet"):
    reader = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1)
    return reader.option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(parts)


def batch(spark, parts):
    return spark.read.schema(DDL).option("recursiveFileLookup", "true").parquet(parts)


def closed(df, parts_df, seconds=900):
    """Buckets the watermark has passed at the end of the stream."""
    newest = parts_df.agg(F.max("ts")).first()[0]
    mark = newest - dt.timedelta(seconds=60)
    return df.filter(F.col("bucket") + F.make_interval(secs=F.lit(seconds)) <= F.lit(mark))


def as_set(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_buckets(spark, parts):
    stream = Z.run_to_table(Z.bucket_stream(source(spark, parts), JOBS), "t-buckets")
    whole = closed(D.bucketise(D.datafeed(batch(spark, parts), JOBS)), batch(spark, parts))
    cols = ["job", "entity", "bucket", "docs", "total", "peak"]
    assert as_set(stream, *cols) == as_set(whole, *cols) and stream.count() > 100


def test_detector_across_batches(spark, parts, tmp_path):
    detector = Z.Detector(JOBS, str(tmp_path / "d"))
    query = detector.start(Z.bucket_stream(source(spark, parts), JOBS), str(tmp_path / "state"))
    query.awaitTermination()
    assert len({r["batch"] for r in spark.read.parquet(str(tmp_path / "d/scores")).select("batch").collect()}) > 3
    whole = closed(D.bucketise(D.datafeed(batch(spark, parts), JOBS)), batch(spark, parts))
    cols = ["job", "entity", "bucket", "actual", "seen", "score"]
    want, got = D.score(whole, JOBS), detector.scores(spark)
    # A silent entity is scored up to the last bucket the job had when the batch closed.
    assert as_set(got, *cols) == as_set(want, *cols)


def test_detector_replay_does_not_change_results(spark, tmp_path):
    detector = Z.Detector(JOBS[:1], str(tmp_path / "d"))
    layout = "job STRING, entity STRING, bucket TIMESTAMP, docs BIGINT, values BIGINT, total DOUBLE, peak DOUBLE"
    def closed_buckets(numbers):
        return spark.createDataFrame(
            [("s/errors", "u", T0 + dt.timedelta(minutes=15 * b), 1 + b % 3, 0, None, None) for b in numbers],
            layout,
        )

    detector.on_batch(closed_buckets(range(20)), 0)
    detector.on_batch(closed_buckets(range(20, 40)), 1)
    first = as_set(detector.scores(spark), "bucket", "score", "seen")
    detector.on_batch(closed_buckets(range(20, 40)), 1)
    assert as_set(detector.scores(spark), "bucket", "score", "seen") == first and len(first) == 40


def test_sparse_and_rare_only_detectors(spark, tmp_path):
    """One filled bucket in 15 hours: history is counted in filled buckets, however long ago."""
    jobs = [D.Job("s", "peak", "d", "high_max", "value"), D.Job("s", "odd", "d", "rare", split=("user",)),
            D.Job("s", "quiet", "d", "low_count")]
    layout = Z.Detector.BUCKETS
    rng = random.Random(3)
    data = [
        (job, entity, T0 + dt.timedelta(hours=15 * b), 1, 1, v, v)
        for b in range(60)
        for v in [rng.gauss(5, 1) + 40 * (b == 57)]
        for job, entity in [("s/peak", ""), ("s/odd", "x" if b != 55 else "y"), ("s/quiet", "")]
    ]
    detector = Z.Detector(jobs, str(tmp_path / "d"))
    for b in range(0, 60, 12):
        detector.on_batch(spark.createDataFrame(data[3 * b : 3 * b + 36], layout), b // 12)
    cols = ["job", "entity", "bucket", "actual", "seen", "score"]
    whole = D.score(spark.createDataFrame(data, layout), jobs)
    assert as_set(detector.scores(spark), *cols) == as_set(whole, *cols)
    assert detector.scores(spark).filter("score > 75").count() >= 2
    alone = Z.Detector(jobs[1:2], str(tmp_path / "r"))
    alone.on_batch(spark.createDataFrame(data, layout), 0)
    assert alone.scores(spark).count() == 60


def test_create_only(spark, tmp_path):
    rows = [(T0, "a"), (T0, "a"), (T0, "b"), (T0 + dt.timedelta(minutes=1), "a")]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    out = Z.run_to_table(Z.create_only(stream, ["k", "ts"]), "t-dedup")
    assert out.count() == 3


def test_late_rows_go_aside(spark, tmp_path):
    rows = [(T0, T0 + dt.timedelta(hours=2)), (T0, T0 + dt.timedelta(hours=2, seconds=1))]
    ddl = "ts timestamp, arrived timestamp"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    good, late = str(tmp_path / "good"), str(tmp_path / "late")
    Z.write_split(stream, F.col("arrived"), good, late, str(tmp_path / "st")).awaitTermination()
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(late).count() == 1


def test_sessions(spark, tmp_path):
    def at(m):
        return T0 + dt.timedelta(minutes=m)

    rows = [
        (at(0), "START RequestId: r1 Version: 1"), (at(1), "[INFO]\tr1\thello"), (at(2), "END RequestId: r1"),
        (at(2), "REPORT RequestId: r1\tDuration: 9.5 ms\tBilled Duration: 100 ms\tMemory Size: 1 MB"
                "\tMax Memory Used: 64 MB"),
        (at(60), '{"requestId":"r1"}'), (at(200), "START RequestId: r2 Version: 1"),
    ]
    ddl = "ts timestamp, message string"
    df = spark.createDataFrame(rows, ddl)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    out = Z.run_to_table(Z.invocation_stream(stream), "t-sessions").orderBy("opened").collect()
    assert [(r["request_id"], r["app_lines"], r["reports"]) for r in out] == [("r1", 1, 1), ("r1", 1, 0)]
    assert out[0]["duration_ms"] == 9.5 and out[0]["memory_mb"] == 64
    assert invocations.assemble(df).count() == 2

"""State of streaming detectors: what is written, what is read, what a lost folder does, hand-over."""

from __future__ import annotations

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skyledger.operators import detect as D
from skyledger.streaming import flows as Z
from skyledger.streaming.state import Log

T0 = dt.datetime(2024, 1, 1)


def test_cover_names_every_batch_once():
    log = Log("r", "k STRING", ["k"], lambda df: df, fan=3)
    for b in range(200):
        batches = [x for level, last in log.cover(b) for x in range(last - 3**level + 1, last + 1)]
        assert batches == list(range(b))
        assert len(log.cover(b)) <= 2 * 5


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


JOBS = [D.Job("s", "up", "d", "high_count", split=("user",)), D.Job("s", "peak", "d", "high_max", "v", ("user",)),
        D.Job("s", "odd", "d", "rare", split=("user",))]


def buckets(spark, entities, numbers, jobs=JOBS, seed=1):
    rng = random.Random(seed)
    data = [
        (j.key, f"user-{e}", T0 + dt.timedelta(minutes=15 * b), rng.randrange(1, 9), 1, float(b % 7), float(b % 5))
        for j in jobs
        for e in entities
        for b in numbers
    ]
    return spark.createDataFrame(data, Z.Detector.BUCKETS)


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """One per cent of the entities make about one per cent of the state."""
    detector = Z.Detector(JOBS, str(tmp_path / "d"))
    detector.on_batch(buckets(spark, range(4000), range(6)), 0)
    whole = size(tmp_path / "d/history") + size(tmp_path / "d/rare")
    detector.on_batch(buckets(spark, range(40), range(6, 12)), 1)
    second = size(tmp_path / "d/history/level=0/upto=1") + size(tmp_path / "d/rare/level=0/upto=1")
    assert size(tmp_path / "d/history") + size(tmp_path / "d/rare") == whole + second
    empty = 40 * 1500  # schemas and statistics of the small files
    assert second < 0.02 * whole + empty
    rows = lambda p: spark.read.parquet(str(tmp_path / f"d/{p}")).count()
    assert rows("history/level=0/upto=1") == 0.01 * rows("history/level=0/upto=0")


def test_state_merges_and_scores_stay_those_of_one_batch(spark, tmp_path):
    jobs = [*JOBS, D.Job("s", "quiet", "d", "low_count", split=("user",))]
    detector = Z.Detector(jobs, str(tmp_path / "d"), fan=2)
    rng = random.Random(4)
    whole = []
    for b in range(9):
        users = rng.sample(range(12), 4)
        part = buckets(spark, users, range(14 * b, 14 * b + 14), jobs, b)
        whole.append(part)
        detector.on_batch(part, b)
        if b in (3, 6):
            detector.on_batch(part, b)  # a replay, also of a batch that merged
    every = whole[0]
    for part in whole[1:]:
        every = every.unionByName(part)
    cols = ["job", "entity", "bucket", "actual", "seen", "score"]
    key = lambda df: sorted((*r[:3], round(r[3], 6), r[4], round(r[5], 6)) for r in df.select(*cols).collect())
    want, got = key(D.score(every, jobs)), key(detector.scores(spark))
    # a silent entity is scored up to the last bucket of its job, in the batch that knows of it
    assert got == want
    levels = {p.name for p in (tmp_path / "d/history").iterdir()}
    assert {"level=1", "level=2", "level=3"} <= levels
    kept = {p.name for p in (tmp_path / "d/history/level=0").iterdir() if not p.name.startswith(".")}
    assert kept == {"upto=8"}


def test_lost_state_is_an_error(spark, tmp_path):
    detector = Z.Detector(JOBS[:1], str(tmp_path / "d"))
    for b in range(2):
        detector.on_batch(buckets(spark, range(3), range(6 * b, 6 * b + 6), JOBS[:1]), b)
    shutil.move(tmp_path / "d/history/level=0/upto=0", tmp_path / "elsewhere")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        detector.on_batch(buckets(spark, range(3), range(12, 18), JOBS[:1]), 2)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        Z.Detector(JOBS[:1], str(tmp_path / "other"), resume=True).on_batch(buckets(spark, [1], [1], JOBS[:1]), 0)


DOCS = "ts timestamp, dataset string, user string, v double"


def test_backfill_then_stream_equals_one_batch(spark, tmp_path):
    """D17 over several files, with jobs of 15 and of 60 minutes and one that scores silence."""
    jobs = [*JOBS, D.Job("s", "quiet", "d", "low_count"), D.Job("s", "hour", "d", "high_mean", "v", ("user",), span="60 minutes")]
    rng = random.Random(6)
    data = sorted(
        (T0 + dt.timedelta(seconds=rng.uniform(0, 36 * 3600)), "d", f"u{rng.randrange(4)}", rng.gauss(5, 2))
        for _ in range(1500)
    )
    for i in range(3):
        spark.createDataFrame(data[500 * i : 500 * i + 500], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    docs = spark.read.schema(DOCS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    until = dt.datetime(2024, 1, 1, 18, tzinfo=dt.timezone.utc)
    root = str(tmp_path / "d")
    first = Z.Detector(jobs, root).backfill(docs, until)
    assert first.agg(F.max("bucket")).first()[0] < until.replace(tzinfo=None)
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    rest = stream.parquet(f"{tmp_path}/in").filter(F.col("ts") >= F.lit(until))
    detector = Z.Detector(jobs, root, resume=True)
    detector.start(Z.bucket_stream(rest, jobs), str(tmp_path / "state")).awaitTermination()
    mark = docs.agg(F.max("ts")).first()[0] - dt.timedelta(seconds=60)
    want = []
    for span, mine in D.by_span(jobs).items():
        seconds = D.span_seconds(span)
        closed = D.bucketise(D.datafeed(docs, mine), span).filter(
            F.col("bucket") + F.make_interval(secs=F.lit(seconds)) <= F.lit(mark)
        )
        want.append(D.score(closed, mine, seconds))
    cols = ["job", "entity", "bucket", "actual", "seen", "score"]
    key = lambda df: sorted((*r[:3], round(r[3], 6), r[4], round(r[5], 6)) for r in df.select(*cols).collect())
    assert key(detector.scores(spark)) == key(want[0].unionByName(want[1]))
    with pytest.raises(ValueError):
        Z.Detector(jobs, root).backfill(docs, until + dt.timedelta(minutes=15))


def test_influencers_use_the_span_of_their_job(spark):
    job = D.Job("s", "hour", "d", "high_count", influencers=("cloud.region",), span="60 minutes")
    data = [(T0 + dt.timedelta(minutes=m), "d", ("r1" if m < 15 else "r2",)) for m in range(60)]
    docs = spark.createDataFrame(data, "ts timestamp, dataset string, cloud struct<region:string>")
    flagged = spark.createDataFrame([("s/hour", "", T0)], "job string, entity string, bucket timestamp")
    out = {r["value"]: (r["docs"], r["share"]) for r in D.influencers(docs, [job], flagged).collect()}
    assert out == {"r2": (45, 0.75), "r1": (15, 0.25)}
    assert D.influencers(docs, [job], flagged.limit(0)).count() == 0

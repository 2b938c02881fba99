"""Detectors against a plain Python model and hand-made series."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skyledger.operators import detect as D
from skyledger.plans import jobs as J

SPAN = 900
T0 = 1_704_067_200


def job(function, split=(), field="value"):
    return D.Job("g", "j", "d", function, "" if function in D.COUNTS else field, split)


def docs(rows, data):
    """(bucket number, entity, value) rows as documents."""
    return rows(
        [(dt.datetime.fromtimestamp(T0 + b * SPAN + i % SPAN, dt.UTC).replace(tzinfo=None), "d", e, v)
         for i, (b, e, v) in enumerate(data)],
        "ts timestamp_ntz, dataset string, name string, value double",
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def scored(rows, data, function, split=("name",)):
    out = D.detect(docs(rows, data), [job(function, split)])
    return {
        (r["entity"], (int(r["b"]) - T0) // SPAN): r
        for r in out.select("*", F.unix_seconds("bucket").alias("b")).collect()
    }


def model(series, function, fill):
    """Scores of one entity: {bucket: (x, n, score)}."""
    keys = sorted(series)
    if fill:
        series = {b: series.get(b, 0.0) for b in range(keys[0], keys[-1] + 1)}
    out, past = {}, []
    for b in sorted(series):
        x, window = series[b], past[-D.HISTORY:]
        score = 0.0
        if len(window) >= D.WARM_UP:
            mu, sd = statistics.fmean(window), statistics.stdev(window)
            z = max(-100, min(100, (x - mu) / max(sd, 0.01 * abs(mu), 1e-9)))
            z = -z if function.startswith("low") else abs(z) if function == "count" else z
            score = 0.0 if z <= 0 else min(100.0, 10 * math.log10(1 + math.exp(1.702 * z)))
        out[b] = (x, len(window), score)
        past.append(x)
    return out


@pytest.mark.parametrize("function", ["high_count", "low_count", "count"])
def test_counts_match_the_zero_filled_model(rows, function):
    rng = random.Random(7)
    data = [(b, e, 1.0) for e in "abc" for b in range(160) if rng.random() < 0.4
            for _ in range(rng.randint(1, 6))]
    data += [(159, "a", 1.0)]
    got = scored(rows, data, function)
    last = max(b for b, _, _ in data)
    for e in "abc":
        series = {}
        for b, name, _ in data:
            if name == e:
                series[b] = series.get(b, 0.0) + 1
        if function != "high_count":
            series.setdefault(last, 0.0)
        want = model(series, function, fill=True)
        for b, (x, n, score) in want.items():
            if function == "high_count" and x == 0:
                assert score == 0.0 and (e, b) not in got
                continue
            assert got[e, b]["actual"] == x and got[e, b]["seen"] == n
            assert got[e, b]["score"] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize(
    "function,fold",
    [("high_mean", statistics.fmean), ("low_mean", statistics.fmean), ("high_sum", sum),
     ("high_max", max)],
)
def test_values_match_the_model(rows, function, fold):
    rng = random.Random(3)
    data = [(b, "a", rng.gauss(10, 3)) for b in range(130) if rng.random() < 0.7
            for _ in range(rng.randint(1, 4))]
    series = {}
    for b, _, v in data:
        series.setdefault(b, []).append(v)
    want = model({b: fold(v) for b, v in series.items()}, function, fill=False)
    got = scored(rows, data, function)
    assert len(got) == len(want)
    for b, (_, n, score) in want.items():
        assert got["a", b]["seen"] == n and got["a", b]["score"] == pytest.approx(score, abs=1e-5)


def test_flat_series_spike_and_warm_up(rows):
    flat = [(b, "a", 1.0) for b in range(20)]
    got = scored(rows, flat + [(20, "a", 1.0)] * 40, "high_count")
    assert all(got["a", b]["score"] == 0 for b in range(20))
    assert got["a", 20]["score"] == 100.0
    early = scored(rows, flat[:5] + [(5, "a", 1.0)] * 40, "high_count")
    assert early["a", 5]["score"] == 0.0


def test_drop_to_zero_is_seen_while_others_go_on(rows):
    data = [(b, "a", 1.0) for b in range(20) for _ in range(10)]
    data += [(b, "b", 1.0) for b in range(25)]
    got = scored(rows, data, "low_count")
    assert got["a", 20]["actual"] == 0 and got["a", 20]["score"] > D.MAJOR
    assert got["b", 24]["score"] == 0


def test_constant_values(rows):
    got = scored(rows, [(b, "a", 5.0) for b in range(20)] + [(20, "a", 5.2)], "high_mean")
    assert got["a", 19]["score"] == 0 and got["a", 20]["score"] > 0


def test_rare(rows):
    data = [(b, "usual", 1.0) for b in range(40)] + [(30, "odd", 1.0), (39, "odd", 1.0)]
    got = scored(rows, data, "rare")
    assert got["usual", 39]["score"] == 0
    assert got["odd", 30]["score"] == 100.0
    assert got["odd", 39]["score"] == pytest.approx(100 * (1 - (1 / 39) / 0.05))
    assert got["usual", 0]["score"] == 0  # first bucket: nothing to compare with


def test_job_catalogue():
    every = J.jobs_of()
    assert len(every) == 101 and len({j.key for j in every}) == 101
    assert len(J.installable(every)) == 100
    assert {j.function for j in every} == {*D.COUNTS, *D.VALUES, D.RARE}
    assert {j.group for j in J.jobs_of("iot")} == {"iot"}


def test_conditions_and_signals(rows):
    df = rows(
        [("d", "logs", 503, "x"), ("d", "logs", 200, "x"), ("d", "metrics", 503, "x"),
         ("other", "logs", 503, "x")],
        "dataset string, signal string, status int, name string",
    ).withColumn("ts", F.timestamp_seconds(F.lit(T0)))
    spec = D.Job("g", "j", "d", "high_count", where=(("status", "ge", 500), ("name", "in", ("x", "y"))))
    assert D.datafeed(df, [spec]).count() == 1


def test_one_document_feeds_several_jobs(rows):
    df = docs(rows, [(0, "a", 1.0)])
    specs = [job("high_count"), D.Job("g", "k", "d", "high_mean", "value", ("name",))]
    assert sorted(r["job"] for r in D.datafeed(df, specs).collect()) == ["g/j", "g/k"]


def test_listing_and_swimlane(rows):
    data = [(b, "a", 1.0) for b in range(20)] + [(20, "a", 1.0)] * 40
    scores = D.detect(docs(rows, data), [job("high_count", ("name",))])
    top = D.listed(scores).collect()
    assert len(top) == 1 and top[0]["score"] == 100.0
    assert D.swimlane(scores, "1 day").collect()[0]["score"] == 100.0

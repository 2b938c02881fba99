"""Metric documents: shapes, rollups, duplicates, accept window."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skyledger.operators import metrics as M
from skyledger.operators import quantiles
from skyledger.operators import stats as A
from skyledger.sources import documents as docs


def test_explode_keeps_odd_keys(spark, tmp_path):
    doc = {
        "@timestamp": "2024-01-01T00:00:00Z", "cloud": {"region": "r", "account": {"id": "1"}},
        "data_stream": {"dataset": "aws.kubernetes"}, "event": {"dataset": "aws.eks"},
        "metricset": {"name": "m", "period": 60000},
        "aws": {"kinesis": {"metrics": {"GetRecords.Bytes": {"avg": 1, "sum": 2.5, "count": 3},
                                        "Other": {"avg": 1, "sum": 1, "count": 1, "max": 9, "min": 0}},
                            "dimensions": {"Cluster Name": "c", "n": "x"}}},
    }
    outer = json.loads(json.dumps(doc))
    outer["aws"]["dimensions"] = outer["aws"]["kinesis"].pop("dimensions")
    (tmp_path / "m.json").write_text(json.dumps(doc) + "\n" + json.dumps(outer))
    out = docs.read_metrics(spark, str(tmp_path)).collect()
    assert len(out) == 4
    for r in out:
        assert r["dimensions"] == {"Cluster Name": "c", "n": "x"}
        assert r["dataset"] == "aws.kubernetes" and r["period_ms"] == 60000
    first = next(r for r in out if r["metric"] == "GetRecords.Bytes")
    assert (first["avg"], first["sum"], first["count"], first["max"]) == (1.0, 2.5, 3, None)


DIMS = (
    "id int, ts timestamp, dataset string, metric string, account_id string, region string, "
    "dimensions map<string,string>, sum double"
)
HERE = ("1", "us-east-1")


def test_dedup_ignores_the_order_of_dimensions(rows):
    t = dt.datetime(2024, 1, 1)
    df = rows(
        [(2, t, "d", "m", *HERE, {"a": "1", "b": "2"}, 2.0), (1, t, "d", "m", *HERE, {"b": "2", "a": "1"}, 1.0),
         (3, t, "d", "m", *HERE, {"a": "1"}, 3.0), (4, t, "d", "m", "1", "eu-west-1", {"a": "1"}, 3.0),
         (5, t, "d", "m", "2", "us-east-1", {"a": "1"}, 3.0), (6, t, "d", "m", None, None, {"a": "1"}, 3.0),
         (7, t, "d", "m", None, None, {"a": "1"}, 3.0)],
        DIMS,
    )
    assert sorted(r["id"] for r in M.dedup(df, ["id"]).collect()) == [1, 3, 4, 5, 6]
    longer = df.withColumns({c: F.lit(1.0) for c in ("avg", "max", "min")}).withColumn("count", F.lit(1))
    sums = M.rollup(longer, "1 hour", keep=[]).select("account_id", "region", "sum").collect()
    assert sorted((r[0] or "", r[1] or "", r[2]) for r in sums) == [
        ("", "", 6.0), ("1", "eu-west-1", 3.0), ("1", "us-east-1", 6.0), ("2", "us-east-1", 3.0)]


def test_accept_window_edge(rows):
    now = dt.datetime(2024, 1, 1, 12)
    df = rows([(now - dt.timedelta(hours=2),), (now - dt.timedelta(hours=2, seconds=1),)], "ts timestamp")
    good, late = M.split_late(df, F.lit(now))
    assert good.count() == 1 and late.collect()[0]["error_type"] == "timestamp_out_of_range"


def test_rollup_equals_direct_aggregate(rows):
    t = dt.datetime(2024, 1, 1)
    data = [(i, t + dt.timedelta(minutes=i), "d", "m", *HERE, {"u": str(i % 3)}, float(i)) for i in range(100)]
    df = rows(data, DIMS).withColumns(
        {"count": F.lit(1).cast("bigint"), "max": F.col("sum"), "min": F.col("sum"), "avg": F.col("sum")}
    )
    hours = M.rollup(df, "1 hour", keep=["u"])
    days = A.merge_stats(hours.withColumnRenamed("bucket", "ts"), ["dim_u"])
    for r in days.collect():
        values = [float(i) for i in range(100) if str(i % 3) == r["dim_u"]]
        assert (r["sum"], r["count"], r["max"], r["min"]) == (
            sum(values), len(values), max(values), min(values),
        )
        assert r["avg"] == pytest.approx(sum(values) / len(values))


def test_ratio_without_denominator(rows):
    df = rows([("a", "Errors", 1.0)], "k string, metric string, sum double")
    assert M.ratio(df, ["k"], "Errors", "Invocations").collect()[0]["ratio"] is None


@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_percentiles_with_a_hot_group(rows, keys):
    import numpy as np

    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.lognormal(3, 2, 4000), np.full(2000, 7.0)])
    cold = rng.normal(0, 1, 37)
    data = [("hot", float(x)) for x in hot] + [(None, float(x)) for x in cold] + [("one", 5.0)]
    df = rows(data + [("hot", None)], "g string, v double")
    probs = [0.0, 0.5, 0.95, 0.999, 1.0]
    out = quantiles.exact_percentiles(df, keys, "v", probs).collect()
    groups = {"hot": hot, None: cold, "one": np.array([5.0])} if keys else {
        None: np.array([v for _, v in data])
    }
    assert len(out) == len(groups)
    for r in out:
        values = groups[r["g"] if keys else None]
        want = np.quantile(values, probs)
        got = [r[quantiles.label(p)] for p in probs]
        assert got == pytest.approx(list(want), rel=1e-12)


def test_share_of_nothing(rows):
    assert A.share_of(rows([], "k string"), "k").collect() == []


def test_coverage_reports_both_sides(rows):
    want, have = rows([(1,), (2,), (2,)], "id int"), rows([(2,), (3,), (3,)], "id int")
    assert sorted(map(tuple, A.id_coverage(want, have, "id").collect())) == [
        (1, "missing"), (3, "unexpected")
    ]


def test_latest_and_recent(rows):
    df = rows([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted(r["v"] for r in A.latest_per_key(df, ["k"], ["t"]).collect()) == ["y", "z"]
    assert [r["v"] for r in A.recent(df, [F.col("v")], "t", 2, ["k"]).collect()] == ["y", "x"]

"""Paths, runs, retry chains and interval joins against plain Python, with busy keys and chunk borders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import joins, sequences
from skyledger.operators import security as C
from skyledger.operators import traces as T

TREE = "trace_id string, id string, parent_id string, name string"


def paths_of(data):
    """(trace, id) -> path of names, None in and below circles."""
    parent, name = {}, {}
    for t, i, p, n in data:
        parent[t, i] = min((x for x in (parent.get((t, i)), p) if x is not None), default=None)
        name[t, i] = min((x for x in (name.get((t, i)), n) if x is not None), default=None)
    out = {}
    for t, i in parent:
        walk, at = [], i
        while at is not None and (t, at) in parent and len(walk) <= len(parent):
            walk.append(at)
            at = parent[t, at]
        out[t, i] = [name[t, x] for x in reversed(walk)] if len(walk) <= len(parent) else None
    return out


def test_paths_of_random_forests_with_orphans_and_circles(spark):
    rng = random.Random(5)
    data = []
    for t in range(6):
        ids = [f"s{i}" for i in range(30)]
        for k, i in enumerate(ids):
            up = rng.choice([None, "gone", *ids[:k]]) if rng.random() < 0.9 else rng.choice(ids)
            data.append((f"t{t}", i, up, rng.choice(["x", "y", None])))
    data += rng.sample(data, 20)
    found = T.paths(spark.createDataFrame(data, TREE), label="name").collect()
    want = paths_of(data)
    assert {(r["trace_id"], r["id"]): r["path"] for r in found} == want and len(found) == len(want)
    assert None in want.values() and any(v and len(v) > 4 for v in want.values())
    for r in found:
        if r["path"] is not None:
            assert r["depth"] == len(r["path"]) - 1 and r["top"] == r["ids"][0] and r["ids"][-1] == r["id"]


def test_path_of_a_deep_chain_and_of_nothing(spark):
    deep = [("t", str(i), str(i - 1) if i else None, str(i)) for i in range(700)]
    found = {r["id"]: r["path"] for r in T.paths(spark.createDataFrame(deep, TREE), label="name").collect()}
    assert found["699"] == [str(i) for i in range(700)] and found["0"] == ["0"]
    assert T.paths(spark.createDataFrame([], TREE)).count() == 0


def runs_of(data):
    out, by_key = [], {}
    for k, s, t, i in data:
        if s is not None and t is not None:
            by_key.setdefault(k, []).append((t, i, s))
    for k, seq in by_key.items():
        seq.sort()
        mine = []
        for t, i, s in seq:
            if mine and mine[-1][1] == s:
                mine[-1][2:5] = [mine[-1][2] + 1, mine[-1][3], (t, i)]
            else:
                mine.append([k, s, 1, (t, i), (t, i)])
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            out.append((a[0], a[1], a[2], *a[3], *a[4], *((b[1], *b[3]) if b else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 3600])
def test_runs_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice("ab"), rng.choice("FFFSQ"), rng.randrange(90), i) for i in range(300)]
    data += [("long", "F", t, t) for t in range(50)] + [("one", "S", 3, 0), ("none", None, 1, 0), ("none", "F", None, 0)]
    df = spark.createDataFrame(data, "k string, symbol string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = [
        (r["k"], r["symbol"], r["rows"], *(None if v is None else v for v in (
            r["b"], r["begin_id"], r["e"], r["end_id"], r["next_symbol"], r["n"], r["next_id"])))
        for r in sequences.runs(df, ["k"], chunk_seconds=chunk).withColumns(
            {"b": F.unix_seconds("begin_at"), "e": F.unix_seconds("end_at"), "n": F.unix_seconds("next_at")}
        ).collect()
    ]
    assert sorted(got, key=str) == runs_of(data)


SPANS = "trace_id string, name string, s long, id long, kind string, subtype string, outcome string"


def chains(spark, data, **options):
    df = spark.createDataFrame(data, SPANS).withColumn("ts", F.timestamp_seconds("s"))
    out = T.retry_chains(df, **options).select(
        "trace_id", "name", "attempts", *[F.unix_seconds(c) for c in ("first_at", "last_at", "queued_at", "recovered_at")]
    )
    return sorted(map(tuple, out.collect()), key=str)


def steps(trace, text, name="put"):
    """F and S are attempts, Q is a queue span, in seconds."""
    return [
        (trace, "send" if c == "Q" else name, s, s, "span", "sqs" if c == "Q" else None, "failure" if c == "F" else "success")
        for s, c in enumerate(text)
        if c != "."
    ]


def test_retry_chains_need_their_order(spark):
    data = (
        steps("right", "FFQS") + steps("reversed", "QFF") + steps("once", "FQ") + steps("recovered", "FFSQ")
        + steps("interleaved", "FQFQ") + steps("twice", "FFQFFFQ") + steps("late", "FF....Q....F")
        + steps("two", "F.F.Q") + [("two", "get", s, 100 + s, "span", None, "failure") for s in (1, 3, 5)]
    )
    data += [("tie", "put", 1, 1, "span", None, "failure"), ("tie", "put", 1, 2, "span", None, "failure"),
             ("tie", "send", 1, 3, "span", "sqs", "success"), ("tie2", "put", 1, 1, "span", None, "failure"),
             ("tie2", "put", 1, 3, "span", None, "failure"), ("tie2", "send", 1, 2, "span", "sqs", "success"),
             ("root", "put", 1, 1, "transaction", None, "failure"), (None, "put", 1, 1, "span", None, "failure"),
             ("untimed", "put", None, 1, "span", None, "failure")]
    want = sorted(
        [
            ("right", "put", 2, 0, 1, 2, 3), ("twice", "put", 2, 0, 1, 2, None), ("twice", "put", 3, 3, 5, 6, None),
            ("late", "put", 2, 0, 1, 6, None), ("two", "put", 2, 0, 2, 4, None), ("two", "get", 2, 1, 3, 4, None),
            ("tie", "put", 2, 1, 1, 1, None),
        ],
        key=str,
    )
    assert chains(spark, data) == want
    assert chains(spark, data, chunk_seconds=1) == want
    assert chains(spark, data, attempts=3) == [("twice", "put", 3, 3, 5, 6, None)]
    assert chains(spark, []) == []


def test_interval_join_equals_all_pairs_with_busy_keys(spark):
    rng = random.Random(8)
    left = [(rng.choice(["hot", "hot", "a", None]), i, rng.randrange(0, 2_000_000)) for i in range(120)]
    right = [(rng.choice(["hot", "hot", "b", "a", None]), i, rng.randrange(0, 2_000_000)) for i in range(400)]
    left += [("hot", 1000, None), ("edge", 1, 500), ("edge", 1, 500)]
    right += [("hot", 1000, None), ("edge", 7, 0), ("edge", 8, 600), ("edge", 9, 601), ("edge", 10, -1)]
    at = lambda df, name: df.withColumn(name, F.timestamp_micros("us")).drop("us")
    a = at(spark.createDataFrame(left, "ip string, x long, us long"), "ts")
    b = at(spark.createDataFrame(right, "ip string, y long, us long"), "at")
    for before, after in [(0.0005, 0.0001), (0.05, 0.2), (0, 0)]:
        want = sorted(
            (i, x, y)
            for i, x, s in left for j, y, e in right
            if i is not None and i == j and None not in (s, e) and s - before * 1e6 <= e <= s + after * 1e6
        )
        for most in (100_000, 3):
            got = joins.interval_join(a, b, ["ip"], before, after, most=most)
            assert sorted(map(tuple, got.select("ip", "x", "y").collect())) == want
    assert len([w for w in want if w[0] == "edge"]) == 0


def test_evidence_of_an_exfiltration(spark):
    at = lambda df: df.withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long"))).drop("s")
    findings = at(spark.createDataFrame([("f1", "x", 100.0), ("f2", "x", 1000.0), ("f3", "y", 100.0), ("f4", None, 1.0)],
                                        "finding_id string, ip string, s double"))
    events = at(spark.createDataFrame([("e1", "x", 99.999999), ("e2", "x", 100.0), ("e3", "x", 110.000001), ("e4", "y", 101.0)],
                                      "evidence_id string, ip string, s double"))
    flows = at(spark.createDataFrame([("w1", "x", 90.0, 7), ("w2", "x", 110.0, 5), ("w3", "x", 1000.0, 50), ("w4", "y", 99.0, 3)],
                                     "evidence_id string, ip string, s double, bytes int"))
    out = C.exfiltration_evidence(findings, events, flows, 10, min_events=2, min_bytes=10).collect()
    assert sorted((r["finding_id"], r["kind"], r["evidence_id"], r["offset_us"], r["bytes"]) for r in out) == [
        ("f1", "data_event", "e1", -1, None), ("f1", "data_event", "e2", 0, None),
        ("f1", "flow", "w1", -10_000_000, 7.0), ("f1", "flow", "w2", 10_000_000, 5.0),
    ]

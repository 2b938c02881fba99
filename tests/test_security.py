"""Chains and exfiltration against brute force, with busy actors and chunk borders."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyledger.operators import quality as Q
from skyledger.operators import security as C
from skyledger.sources.sinks import Rule

STEPS = C.ESCALATION_STEPS


def calls(rows, data):
    df = rows([(a, s, float(t)) for a, s, t in data], "actor string, action string, t double")
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("bigint")))


def found(df):
    out = df.select("actor", F.unix_micros("chain_start"), F.unix_micros("chain_end"))
    return sorted(map(tuple, out.collect()))


def brute(data, window):
    """Latest chain start for every last step, in microseconds."""
    out = set()
    for actor in {a for a, _, _ in data}:
        seen = sorted({(round(t * 1_000_000), STEPS.index(s) + 1) for a, s, t in data if a == actor and s in STEPS})
        best = [None] * 5
        for t, k in seen:
            if k == 1:
                best[1] = t
            elif best[k - 1] is not None and (best[k] is None or best[k - 1] > best[k]):
                best[k] = best[k - 1]
            if k == 4 and best[3] is not None and t - best[3] <= window * 1_000_000:
                out.add((actor, best[3], t))
    return sorted(out)


def chain(actor, *times):
    return [(actor, s, t) for s, t in zip(STEPS, times, strict=False)]


def test_hand_made_chains(rows):
    data = (
        chain("full", 10, 20, 30, 40) + chain("three", 10, 20, 30) + chain("same", 50, 50, 50, 50)
        + chain("reversed", 50.8, 50.6, 50.4, 50.2) + chain(None, 10, 20, 30, 40)
        + chain("late", 0, 10, 20, 3700) + chain("border", 3500, 3590, 3610, 3700)
        + list(reversed(chain("wrong-order", 40, 30, 20, 10)))
        + [("a1", STEPS[0], 1), ("a2", STEPS[1], 2), ("a1", STEPS[2], 3), ("a1", STEPS[3], 4)]
    )
    assert found(C.ordered_chains(calls(rows, data), ["actor"], 3600)) == [
        ("border", 3500_000_000, 3700_000_000), ("full", 10_000_000, 40_000_000),
        ("same", 50_000_000, 50_000_000),
    ]
    assert C.chain_counts(calls(rows, chain(None, 1, 2, 3, 4)), ["actor"]).count() == 0


def test_unknown_addresses_do_not_correlate(rows):
    one = rows([(None, 5.0), ("a", 9.0)], "ip string, bytes double").withColumn("ts", F.timestamp_seconds(F.lit(50)))
    assert [r["ip"] for r in C.exfiltration(one, one, one).collect()] == ["a"]


def test_random_chains_with_a_busy_actor(rows):
    rng = random.Random(2)
    names = [*STEPS, "Other"]
    data = [
        ("busy" if rng.random() < 0.4 else f"u{rng.randrange(30)}", rng.choice(names), rng.uniform(0, 20000))
        for _ in range(1500)
    ]
    for window in (60, 700):
        got = found(C.ordered_chains(calls(rows, data), ["actor"], window))
        assert got == brute(data, window) and got


def test_chain_counts(rows):
    data = chain("x", 10, 20, 30, 40) + chain("x", 50, 60, 70, 80) + chain("y", 1, 2, 3)
    out = C.chain_counts(calls(rows, data), ["actor"], "1 hour").collect()
    assert [(r["actor"], r["n_ListUsers"], r["n_AssumeRole"]) for r in out] == [("x", 2, 2)]


def test_exfiltration_against_brute_force(rows):
    rng = random.Random(4)

    def some(n):
        return [
            ("hot" if rng.random() < 0.4 else f"ip{rng.randrange(8)}", rng.randrange(0, 30000), rng.randrange(1, 9))
            for _ in range(n)
        ]

    finding, data, flow = some(60), some(200), some(200)
    make = lambda d: rows(d, "ip string, t int, bytes int").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    out = C.exfiltration(make(finding), make(data), make(flow), 1000, min_events=2, min_bytes=5)
    got = sorted(map(tuple, out.select("ip", F.unix_seconds("found_at"), "findings", "data_events",
                                       "egress_bytes").collect()))
    want = []
    for ip, t in sorted({(i, t) for i, t, _ in finding}):
        events = sum(1 for i, s, _ in data if i == ip and abs(s - t) <= 1000)
        sent = float(sum(b for i, s, b in flow if i == ip and abs(s - t) <= 1000))
        if events >= 2 and sent > 5:
            want.append((ip, t, sum(1 for i, s, _ in finding if (i, s) == (ip, t)), events, sent))
    assert got == sorted(want) and want


def test_exfiltration_needs_the_flow(rows):
    make = lambda d: rows(d, "ip string, t int, bytes int").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    empty = make([]) if False else rows([], "ip string, ts timestamp, bytes int")
    one = make([("a", 5, 1)])
    assert C.exfiltration(one, one, empty, 100).count() == 0
    assert C.exfiltration(one, one, one, 100).count() == 1


def test_lineage_keeps_findings_without_follow_up(rows):
    found_ = rows([("arn1",), ("arn2",), ("arn3",)], "arn string")
    hub = rows(
        [("h1", [("arn1",)]), ("h2", [("arn1",), ("arn2",)])],
        "hub_id string, related_findings array<struct<id:string>>",
    )
    lake = rows([("h2", 6), ("h2", 5)], "finding_uid string, severity int")
    out = C.finding_lineage(found_, hub, lake).select("arn", "hub_id", "severity").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [
        ("arn1", "h1", None), ("arn1", "h2", 5), ("arn1", "h2", 6), ("arn2", "h2", 5),
        ("arn2", "h2", 6), ("arn3", None, None),
    ]))


def test_posture_and_tactics(rows):
    df = rows([("1.1", "passed"), ("1.1", "failed"), ("2.1", "passed")], "section string, evaluation string")
    assert {r["section"]: r["pass_rate"] for r in C.posture(df).collect()} == {"1.1": 0.5, "2.1": 1.0}


def test_rule_report_counts_nulls_as_failures(rows):
    df = rows([(1,), (None,), (-1,)], "a int")
    out = Q.rule_report(df, [Rule("positive", F.col("a") > 0)]).collect()[0]
    assert (out["checked"], out["failed"]) == (3, 2)


def test_agreement_sees_missing_streams(rows):
    df = rows([("a", "a"), ("a", "b"), ("a", None)], "e string, s string")
    out = Q.dataset_agreement(df, F.col("e"), F.col("s")).collect()
    assert sorted((r["event_dataset"], str(r["stream_dataset"])) for r in out) == [("a", "None"), ("a", "b")]

"""Trace operators over hand-made trees."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from skyledger.operators import traces as T
from skyledger.sources import documents as docs

DDL = (
    "trace_id string, id string, parent_id string, kind string, name string, service_name string, "
    "start int, duration_us bigint, outcome string, subtype string, destination string"
)


def tree(rows, data):
    """(trace, id, parent, service, start, duration[, outcome, subtype, destination])."""
    full = [
        (t, i, p, "transaction" if p is None else "span", f"op {s}", s, at, d,
         *(list(more) + [None] * 3)[:3])
        for t, i, p, s, at, d, *more in data
    ]
    df = rows(full, DDL).withColumn("outcome", F.coalesce("outcome", F.lit("success")))
    return df.withColumns(
        {
            "ts": F.timestamp_micros(F.col("start").cast("bigint")),
            "transaction_id": F.lit("a"),
            "type": F.lit("t"),
            "span_started": F.when(F.col("kind") == "transaction", 3),
        }
    )


SAMPLE = [
    ("t1", "a", None, "web", 0, 100), ("t1", "b", "a", "api", 10, 30), ("t1", "c", "a", "api", 20, 30),
    ("t1", "d", "b", "db", 15, 5, "failure"), ("t2", "a", None, "web", 0, 10),
    ("t3", "a", None, "web", 0, 10), ("t3", "b", "gone", "web", 1, 2), ("t4", "a", None, "web", 0, 1),
    ("t4", "b", None, "web", 0, 1),
]


def test_validation(rows):
    out = {r["trace_id"]: tuple(r)[1:] for r in T.validate(tree(rows, SAMPLE)).collect()}
    assert out == {
        "t1": (4, 1, 0, True), "t2": (1, 1, 0, False), "t3": (2, 1, 1, False), "t4": (2, 2, 0, True),
    }
    assert [r["id"] for r in T.orphans(tree(rows, SAMPLE)).collect()] == ["b"]


def test_parent_columns(rows):
    out = T.with_parent(tree(rows, SAMPLE), "service_name").collect()
    got = {(r["trace_id"], r["id"]): r["parent_service_name"] for r in out}
    assert len(out) == len(SAMPLE)
    assert got["t1", "d"] == "api" and got["t1", "a"] is None and got["t3", "b"] is None


def test_depths_of_chains_orphans_and_cycles(rows):
    chain = [("long", str(i), str(i - 1) if i else None, "s", i, 1) for i in range(200)]
    cycle = [("loop", "x", "y", "s", 0, 1), ("loop", "y", "x", "s", 0, 1), ("loop", "z", "x", "s", 0, 1)]
    out = T.depths(tree(rows, (SAMPLE + chain + cycle) * 2)).collect()
    got = {(r["trace_id"], r["id"]): (r["depth"], r["top"]) for r in out}
    assert len(out) == len(SAMPLE) + 203
    assert all(got["long", str(i)] == (i, "0") for i in range(200))
    assert got["t1", "d"] == (2, "a") and got["t3", "b"] == (0, "b")
    assert got["loop", "x"] == (None, None) and got["loop", "z"] == (None, None)


def test_path_profile_of_copies_orphans_cycles_and_missing_ids(rows):
    data = [
        ("p", "a", None, "web", 0, 100), ("p", "b", "a", "api", 0, 30), ("p", "b", "a", "api", 0, 20),
        ("p", "c", "b", "db", 0, 5), ("p", "d", "a", "api", 0, 7), ("p", None, "d", "db", 0, 3),
        ("q", "a", None, "web", 0, 10), ("q", "x", "gone", "api", 0, 4), ("q", "y", "x", "db", 0, 9),
        ("loop", "x", "y", "web", 0, 1), ("loop", "y", "x", "web", 0, 1), ("loop", "z", "x", "web", 0, 1),
        ("loop", "s", "s", "web", 0, 1), ("r", "a", "c", None, 0, 6), (None, "a", None, "web", 0, 1),
    ]
    out = T.path_profile(tree(rows, data), "service_name").collect()
    assert {tuple(r["path"]): tuple(r)[1:] for r in out} == {
        ("web",): (2, 2, 110, 53), ("web", "api"): (3, 1, 57, 44), ("web", "api", "db"): (1, 1, 5, 5),
        ("api",): (1, 1, 4, 0), ("api", "db"): (1, 1, 9, 9), (None,): (1, 1, 6, 6),
    }


def test_path_profile_moves_spans_without_children_once_to_their_parent(rows):
    """Found by the round-3 review: every span's list went through each round and through a join of its own."""
    data = [(f"t{i}", "a", None, "web", 0, 9) for i in range(50)]
    data += [(f"t{i}", f"b{n}", "a", f"api{n}", 0, 2) for i in range(50) for n in range(3)]
    staged = []
    own = T.stage
    T.stage = lambda df, label, **options: staged.append(label) or own(df, label, **options)
    try:
        out = T.path_profile(tree(rows, data), "service_name")
    finally:
        T.stage = own
    assert staged == ["call-nodes"]
    assert {tuple(r["path"]): r["traces"] for r in out.collect()} == {
        ("web",): 50, ("web", "api0"): 50, ("web", "api1"): 50, ("web", "api2"): 50,
    }


def test_self_time_with_overlapping_children(rows):
    out = {(r["trace_id"], r["id"]): r["self_us"] for r in T.self_time(tree(rows, SAMPLE)).collect()}
    assert out["t1", "a"] == 40 and out["t1", "b"] == 25
    over = tree(rows, [("t", "a", None, "w", 0, 10), ("t", "b", "a", "w", 0, 9), ("t", "c", "a", "w", 0, 9)])
    assert {r["id"]: r["self_us"] for r in T.self_time(over).collect()}["a"] == 0


def test_service_map_and_fan_out(rows):
    data = SAMPLE + [("t5", "a", None, "web", 0, 9, "success", None, "queue")]
    out = {(r["caller"], r["callee"]): r for r in T.service_map(tree(rows, data)).collect()}
    assert out["web", "api"]["calls"] == 2 and out["web", "api"]["avg_us"] == 30
    assert out["api", "db"]["error_rate"] == 1.0 and out["web", "queue"]["calls"] == 1
    assert ("web", "web") not in out
    assert {r["width"] for r in T.fan_out(tree(rows, SAMPLE)).collect()} == {1, 2}
    wide = [("w", "a", None, "p", 0, 1)] + [("w", str(i), "a", "c", 0, 1) for i in range(3)]
    assert T.fan_out(tree(rows, wide)).collect()[0]["width"] == 3


def test_span_counts(rows):
    out = T.span_count_check(tree(rows, SAMPLE)).filter("trace_id = 't1'").collect()
    assert (out[0]["span_started"], out[0]["observed"], out[0]["missing"]) == (3, 3, 0)


def test_retries_need_a_queue(rows):
    data = [
        ("r", "a", None, "web", 0, 9), ("r", "b", "a", "fn", 1, 1, "failure"),
        ("r", "c", "a", "fn", 2, 1, "failure"), ("r", "d", "a", "dlq", 3, 1, "success", "sqs"),
        ("q", "b", "a", "fn", 1, 1), ("q", "c", "a", "fn", 2, 1),
    ]
    out = T.repeated_spans(tree(rows, data)).collect()
    assert [(r["trace_id"], r["name"], r["attempts"], r["failed"]) for r in out] == [("r", "op fn", 2, 2)]


def test_sibling_gaps_across_chunks_and_with_a_hot_parent(rows):
    rng = random.Random(11)
    data = [("h", f"s{i:04d}", "p", "c", rng.randrange(0, 40_000_000), rng.randrange(1, 50)) for i in range(600)]
    data += [("h", "x", "q", "c", 5, 5)]
    out = T.sibling_gaps(tree(rows, data), 1).collect()
    got = {(r["parent_id"], r["id"]): r["gap_us"] for r in out}
    order = sorted((s for s in data if s[2] == "p"), key=lambda s: (s[4], s[1]))
    assert got["q", "x"] is None and got["p", order[0][1]] is None
    for before, after in zip(order, order[1:], strict=False):
        assert got["p", after[1]] == after[4] - (before[4] + before[5])


def test_sibling_without_a_time_stays(rows):
    df = tree(rows, [("t", "a", "p", "c", 0, 5), ("t", "b", "p", "c", 9, 5), ("t", "c", "p", "c", 20, 5)])
    df = df.withColumn("ts", F.when(F.col("id") != "b", F.col("ts")))
    assert {r["id"]: r["gap_us"] for r in T.sibling_gaps(df).collect()} == {"a": None, "b": None, "c": 15}


def test_spans_delivered_twice(rows):
    once, again = tree(rows, SAMPLE), tree(rows, SAMPLE + [s for s in SAMPLE if s[2] is None])
    count = lambda df: T.with_parent(df, "service_name").filter("parent_id IS NOT NULL").count()
    assert count(once) == count(again)
    calls = lambda df: {(r["caller"], r["callee"]): r["calls"] for r in T.service_map(df).collect()}
    assert calls(once) == calls(again)


def test_linked_traces_keep_absent_upstreams(rows):
    df = rows(
        [("t1", "a", None, "web", {"parent_trace_id": "t0"}), ("t2", "a", None, "fn", {"parent_trace_id": "t1"}),
         ("t2", "b", "a", "fn", {"parent_trace_id": "t1"}), ("t3", "a", None, "fn", None)],
        "trace_id string, id string, parent_id string, service_name string, labels map<string,string>",
    ).withColumn("ts", F.timestamp_seconds(F.lit(1)))
    out = {r["trace_id"]: r["upstream_service"] for r in T.linked_traces(df).collect()}
    assert out == {"t1": None, "t2": "web"}


def test_sampling_keeps_whole_traces(spark):
    df = spark.range(20000).select((F.col("id") % 2000).cast("string").alias("trace_id"), "id")
    kept = T.sample_traces(df, 0.1).groupBy("trace_id").count().collect()
    assert all(r["count"] == 10 for r in kept) and 120 < len(kept) < 280


def test_documents_to_spans_and_errors(spark, tmp_path):
    import json

    tx = {"@timestamp": "2024-01-01T00:00:00Z", "processor": {"event": "transaction"},
          "trace": {"id": "t"}, "transaction": {"id": "x", "name": "n", "type": "request",
          "duration": {"us": 5}, "sampled": True, "span_count": {"started": 2}},
          "faas": {"coldstart": True}, "service": {"name": "s"}, "labels": {"a": 1, "b": "c"},
          "event": {"outcome": "success"}}
    sp = {"@timestamp": "2024-01-01T00:00:01Z", "processor": {"event": "span"}, "trace": {"id": "t"},
          "transaction": {"id": "x"}, "parent": {"id": "x"}, "service": {"name": "s"},
          "span": {"id": "y", "name": "q", "type": "db", "subtype": "sql", "duration": {"us": 3},
                   "destination": {"service": {"resource": "pg"}}}}
    frames = [{"function": "lib", "filename": "l.py", "lineno": 1, "library_frame": True},
              {"function": "mine", "filename": "m.py", "lineno": 2, "library_frame": False}]
    er = {"@timestamp": "2024-01-01T00:00:02Z", "processor": {"event": "error"}, "trace": {"id": "t"},
          "transaction": {"id": "x"}, "parent": {"id": "y"}, "service": {"name": "s"},
          "error": {"id": "e", "culprit": "c", "grouping_key": "random", "exception": [
              {"type": "E", "message": "m", "handled": False, "stacktrace": frames}]}}
    for i, doc in enumerate((tx, sp, er)):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    spans = docs.read_spans(spark, str(tmp_path))
    got = {r["id"]: r for r in spans.collect()}
    assert set(got) == {"x", "y"} and got["x"]["kind"] == "transaction"
    assert got["x"]["coldstart"] and got["x"]["labels"] == {"a": "1", "b": "c"}
    assert got["y"]["destination"] == "pg" and got["y"]["parent_id"] == "x"
    errors = docs.read_errors(spark, str(tmp_path))
    group = T.error_groups(errors).collect()[0]
    assert (group["exception_type"], group["unhandled"], group["top_frame"]) == ("E", 1, "m.py:mine")
    assert T.error_context(errors, spans).collect()[0]["at_name"] == "q"
    assert dt.datetime(2024, 1, 1) == got["x"]["ts"]

"""Documents of unknown layout, null fields, sketches and the stored create-only table."""

from __future__ import annotations

import datetime as dt
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.operators import enrich, sketches
from skyledger.operators import quality as Q
from skyledger.operators import stats as A
from skyledger.sources import sinks


def stripped(x):
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if v is not None}
    return [stripped(v) for v in x] if isinstance(x, list) else x


texts = st.text(alphabet='a":,{}[]\\nul é\n', max_size=8)
leaves = st.none() | st.booleans() | st.integers(-9, 9) | texts
trees = st.recursive(leaves, lambda x: st.lists(x, max_size=4) | st.dictionaries(texts, x, max_size=4), max_leaves=20)


def strip_all(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    doc = F.try_parse_json("t")
    out = df.select("i", F.to_json(doc).alias("before"), enrich.strip_json_nulls(F.to_json(doc)).alias("text"),
                    F.to_json(enrich.strip_variant_nulls(doc)).alias("again"))
    return [r for r in sorted(out.collect())]


def test_nulls_go_at_any_depth(spark):
    rng = random.Random(2)

    def tree(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 5:
            return {rng.choice(["a", "a.b", '":null,', "x,", "{", "\\", ""]) + str(i): tree(depth - 1) for i in range(rng.randrange(4))}
        if kind == 4:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        return [None, rng.randrange(9), rng.choice(['":null,"', "null", ",}", '\\":null', ""]), None][kind]

    docs = [tree(5) for _ in range(600)] + [{"a": None}, {}, [], None, [None], {"a": {"b": None}}, {"a": [{"b": None, "c": 1}, None]}]
    docs += [{f"k{i}": None if i % 2 else i for i in range(5000)}, {"deep": [[[[{"x": None, "y": [None]}]]]]}]
    for doc, r in zip(docs, strip_all(spark, docs), strict=True):
        assert json.loads(r["text"]) == stripped(doc), r["before"]
        assert json.loads(r["again"]) == stripped(doc)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(texts, trees, max_size=5), min_size=20, max_size=40))
def test_nulls_go_from_any_document(docs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for doc, r in zip(docs, strip_all(spark, docs), strict=True):
        assert json.loads(r["text"]) == stripped(doc), r["before"]


def test_strip_nulls_reaches_into_variants(rows):
    df = rows([(1, None, '{"b":{"c":null,"d":1},"e":null}')], "id int, note string, aws string")
    doc = F.struct("id", "note", F.try_parse_json("aws").alias("aws"))
    assert json.loads(df.select(enrich.strip_nulls(doc).alias("t")).first()["t"]) == {"id": 1, "aws": {"b": {"d": 1}}}


def walk(doc, path=""):
    out = {}
    if isinstance(doc, dict):
        for k, v in doc.items():
            out |= walk(v, f"{path}.{k}" if path else k)
    elif isinstance(doc, list):
        if path and not path.endswith("[]"):
            out[path] = "ARRAY"
        for v in doc:
            if isinstance(v, (dict, list)):
                out |= walk(v, f"{path}[]")
    elif doc is not None and path and not path.endswith("[]"):
        out[path] = {"str": "STRING", "int": "BIGINT", "bool": "BOOLEAN"}[type(doc).__name__]
    return out


def test_field_paths_of_odd_documents(rows):
    docs = [
        ("a", {"x": 1, "y": {"z": None, "w": "t"}, "l": [1, {"m": 2}, {"m": 3, "n": {"o": True}}, [{"p": 1}]]}),
        ("a", {"x": "1", "y": 5, "d.e": 1}), ("a", {}), ("b", {"x": None, "l": []}), ("b", [{"q": 1}]), ("b", 7),
        ("c", None), ("b", {"x": None, "l": []}),
    ]
    data = [(d, None if x is None else json.dumps(x)) for d, x in docs]
    found = Q.field_paths(rows(data, "dataset string, t string").withColumn("doc", F.try_parse_json("t"))).collect()
    want: dict = {}
    for d, x in docs:
        for path, kind in (walk(x) if isinstance(x, dict) else {}).items():
            n, kinds = want.get((d, path), (0, set()))
            want[d, path] = (n + 1, kinds | {kind})
    got = {(r["dataset"], r["field"]): (r["docs"], set(r["kinds"])) for r in found}
    assert got == want and got["a", "x"] == (2, {"BIGINT", "STRING"}) and got["a", "l[].n.o"] == (1, {"BOOLEAN"})
    assert {r["dataset"]: r["total"] for r in found} == {"a": 3, "b": 4}
    assert Q.field_paths(rows([], "dataset string, t string").withColumn("doc", F.try_parse_json("t"))).count() == 0


def test_sketches_merge_without_raw_rows(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 1) for _ in range(20_000)]
    df = spark.createDataFrame(
        [(i % 2, i * 60, v, i % 5000) for i, v in enumerate(values)], "g int, s long, v double, u long"
    ).withColumn("ts", F.timestamp_seconds("s"))
    stored = sketches.quantile_sketches(df, ["g"], "v", "1 day")
    assert stored.count() >= 20
    twice = sketches.merge_quantiles(sketches.merge_quantiles(stored, ["g", F.to_date("bucket").alias("d")]), ["g"])
    for r in sketches.quantiles(twice, ["g"], [0.1, 0.5, 0.99]).collect():
        mine = sorted(v for i, v in enumerate(values) if i % 2 == r["g"])
        assert r["n"] == len(mine)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(sum(v <= r[name] for v in mine) / len(mine) - p) < 0.02
    half = twice.select(
        "g", sketches.rank_of("sketch", F.lit(20.0)).alias("r")
    )
    for r in half.collect():
        mine = [v for i, v in enumerate(values) if i % 2 == r["g"]]
        assert abs(sum(v <= 20 for v in mine) / len(mine) - r["r"]) < 0.02
    users = sketches.distinct_counts(sketches.distinct_sketches(df, ["g"], "u", "1 day"), ["g"])
    assert all(abs(r["distinct"] - 2500) < 0.06 * 2500 for r in users.collect())
    sets = sketches.set_sketches(df, ["g"], "u", "1 day")
    early = F.col("bucket") < F.lit(dt.datetime(1970, 1, 3))
    out = sketches.compare_sets(sketches.merge_sets(sets.filter(early), ["g"]), sketches.merge_sets(sets.filter(~early), ["g"]), ["g"])
    assert {tuple(r) for r in out.collect()} == {(0, 1440, 2500, 1440, 1060, 0), (1, 1440, 2500, 1440, 1060, 0)}


def test_create_only_table_reads_only_what_may_clash(spark, tmp_path):
    name = f"stored_{tmp_path.name}".replace("-", "_")
    table = sinks.CreateOnlyTable(name, ["k", "ts"], buckets=4, path=str(tmp_path / "t"))
    day = lambda d: dt.datetime(2024, 1, d, 5)
    ddl = "k string, ts timestamp, v int"
    make = lambda data: spark.createDataFrame(data, ddl)
    table.append(make([("a", day(1), 2), ("a", day(1), 1), (None, day(1), 3), ("a", day(2), 4), ("v", None, 5)]), ["v"])
    table.append(make([("a", day(1), 9), ("b", day(1), 6), (None, day(1), 7), (None, day(2), 8), ("v", None, 9)]), ["v"])
    rows = sorted(((r["k"] or "-", r["ts"].day if r["ts"] else 0, r["v"]) for r in table.read(spark).collect()))
    assert rows == [("-", 1, 3), ("-", 2, 8), ("a", 1, 1), ("a", 2, 4), ("b", 1, 6), ("v", 0, 5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = table.fresh(make([("c", day(2), 1)]), ["v"])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        join, stored = plan.split("LeftAnti")[1], [x for x in plan.split("\n") if "_date" in x and "Scan parquet" in x]
        assert len(stored) == 1 and "2024-01-02" in stored[0] and "2024-01-01" not in stored[0]
        after = join[join.index(stored[0][-80:]) - 600 : join.index(stored[0][-80:])]
        assert "Exchange" not in after.split("Sort")[-1]
        assert "ReadSchema: struct<_key:string>" in plan
        assert fresh.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_latest_row_keeps_variants(rows):
    df = rows([(1, 1, '{"a":1}'), (1, 2, '{"a":2}'), (None, 1, '{"a":3}')], "k int, t int, s string").withColumn(
        "doc", F.try_parse_json("s")
    )
    out = A.latest_per_key(df, ["k"], ["t"])
    assert out.columns == df.columns
    assert {(r["k"], r["j"]) for r in out.select("k", F.to_json("doc").alias("j")).collect()} == {(1, '{"a":2}'), (None, '{"a":3}')}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Aggregate" not in plan

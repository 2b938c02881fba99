"""Enrichment, routing, reading and writing of documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skyledger.functions import scalars as X
from skyledger.functions.fields import pick, promote
from skyledger.operators import enrich, filters, route
from skyledger.sources import documents as docs
from skyledger.sources import registry as R
from skyledger.sources import sinks

CLOUD = "struct<region:string,account:struct<id:string>>"


def one(df):
    return df.collect()[0]


def raw(rows, service_id, **fields):
    ddl = (
        f"id int, ts timestamp, service_id string, cloud {CLOUD}, "
        "event struct<outcome:string,dataset:string>, log struct<level:string>, "
        "service struct<name:string,type:string>, agent struct<type:string,version:string,name:string>, "
        "data_stream struct<type:string,dataset:string,namespace:string>"
    )
    import datetime as dt

    row = (
        1, dt.datetime(2024, 3, 5, 6, 7), service_id, fields.get("cloud"),
        fields.get("event", ("success", None)), fields.get("log"), fields.get("service"),
        fields.get("agent"), fields.get("data_stream"),
    )
    return rows([row], ddl)


def test_enrich_fills_missing_fields(rows):
    out = one(enrich.enrich(raw(rows, "lambda"), "logs", "id"))
    assert out["data_stream"]["dataset"] == "aws.lambda_logs"
    assert out["event"]["dataset"] == "aws.lambda_logs" and out["event"]["module"] == "aws"
    assert out["input"]["type"] == "aws-cloudwatch" and out["agent"]["type"] == "filebeat"
    assert out["log"]["level"] == "info" and out["service"]["name"] == "lambda"
    assert out["host"]["name"].startswith("ip-") and out["host"]["hostname"].startswith("lambda-")
    assert out["aws_context"]["s3"]["object"]["key"].startswith(
        "AWSLogs/814726593401/lambda/us-east-1/2024/03/05/lambda_"
    )
    assert out["aws_context"]["firehose"] is None and out["telemetry"] is None


def test_enrich_keeps_what_is_there(rows):
    df = raw(
        rows, "lambda", cloud=("eu-west-1", ("42",)), event=("failure", "aws.lambda"), log=("error",),
        service=("mine", None), agent=("own", "1", "n"), data_stream=("logs", "custom", "prod"),
    )
    out = one(enrich.enrich(df, "logs", "id"))
    # The event's dataset and the stream's dataset are allowed to differ.
    assert out["event"]["dataset"] == "aws.lambda"
    assert tuple(out["data_stream"]) == ("logs", "custom", "prod")
    assert out["agent"]["type"] == "own" and out["log"]["level"] == "error"
    assert tuple(out["service"]) == ("mine", None)
    assert "-42" in out["aws_context"]["s3"]["bucket"]["name"]


def test_unknown_services_have_no_metrics(rows):
    df = rows([("lambda",), ("kendra",), ("nobody",), (None,)], "s string")
    assert [r[0] for r in df.select(R.supports_metrics(F.col("s"))).collect()] == [True, False, False, False]


def test_enrich_is_repeatable(rows):
    first = one(enrich.enrich(raw(rows, "ec2"), "logs", "id"))
    assert first == one(enrich.enrich(raw(rows, "ec2"), "logs", "id"))


@pytest.mark.parametrize(
    "kind,service,dataset",
    [
        ("metrics", "lambda", "aws.lambda"), ("logs", "lambda", "aws.lambda_logs"),
        ("metrics", "fargate", "aws.ecs_metrics"), ("logs", "wafv2", "aws.waf"),
        ("metrics", "ec2", "aws.ec2_logs"), ("logs", "unknown", "aws.unknown"),
        ("logs", "cspm", "cloud_security_posture.findings"), ("logs", "kspm", "cloud_security_posture.findings"),
    ],
)
def test_resolve_dataset(rows, kind, service, dataset):
    df = rows([(service,)], "s string").select(R.resolve_dataset(F.col("s"), kind).alias("d"))
    assert one(df)["d"] == dataset


@pytest.mark.parametrize(
    "service,override,source",
    [("s3", None, "s3"), ("s3", "default", "s3"), ("s3", "otel", "otel"), ("sqs", "", "cloudwatch"),
     ("guardduty", None, "api"), ("firehose", None, "firehose")],
)
def test_resolve_source(rows, service, override, source):
    df = rows([(service, override)], "s string, o string")
    assert one(df.select(R.resolve_source(F.col("s"), F.col("o")).alias("x")))["x"] == source


def test_category_list_scalar_missing(rows):
    df = rows([('["a","b"]',), ('"c"',), (None,)], "t string").withColumn(
        "v", F.try_parse_json("t")
    )
    out = df.select(enrich.normalise_category(F.col("v"), df.schema["v"].dataType).alias("c"))
    assert [r["c"] for r in out.collect()] == [["a", "b"], ["c"], None]


def test_strip_nulls_keeps_array_elements(rows):
    df = rows([(1, None, [1, None])], "a int, b string, c array<int>")
    text = one(df.select(enrich.strip_nulls(F.struct("*")).alias("t")))["t"]
    assert json.loads(text) == {"a": 1, "c": [1, None]}


def test_routing(rows):
    df = rows(
        [("aws.vpcflow", None), ("aws.vpcflow", "aws.s3_storage_lens"),
         ("aws.vpcflow", "cloud_security_posture.findings"), ("aws.xray", None)],
        "ds string, ov string",
    )
    prefix = F.lit("logs-aws")
    index = route.route_override(F.col("ov"), prefix, route.index_name(prefix, F.col("ds")))
    assert [r[0] for r in df.select(index).collect()] == [
        "logs-aws.vpcflow-default", "logs-aws.s3_storage_lens-default",
        "logs-cloud_security_posture.findings-default", "traces-aws.xray-default",
    ]


def test_error_documents_follow_their_stream_not_the_batch(rows):
    df = rows(
        [(("logs", "apm.error", "default"), None, "lambda"), (None, "aws.rdsproxy", "rds"),
         (None, None, "vpc"), (None, None, "xray"), (("logs", "aws.lambda_logs", "prod"), "aws.x", "lambda")],
        "data_stream struct<type:string,dataset:string,namespace:string>, __dataset string, "
        "service_id string",
    )
    out = route.stream_of(df, "traces").collect()
    assert [(r["stream_type"], r["stream_dataset"]) for r in out] == [
        ("logs", "apm.error"), ("traces", "aws.rdsproxy"), ("traces", "aws.vpcflow"),
        ("traces", "aws.xray"), ("logs", "aws.x"),
    ]


def test_log_group_rules(rows):
    df = rows([("/aws-glue/x",), ("/AWS/SageMaker/y",), ("/other",), (None,)], "g string")
    out = [r[0] for r in df.select(route.route_by_log_group(F.col("g"))).collect()]
    assert out == ["logs-aws.glue", "logs-aws.sagemaker", "logs-aws.cloudwatch", "logs-aws.cloudwatch"]


def test_prefix_rule(rows):
    names = ["logs-aws", "-x", "x_", "a" * 80, "a" * 81, "a b", "", None, "  ok  "]
    df = rows([(n,) for n in names], "p string")
    out = [r[0] for r in df.select(filters.valid_prefix(F.col("p"))).collect()]
    assert out == [True, False, False, True, False, False, False, False, True]


def test_index_patterns(rows):
    df = rows(
        [("logs", "aws.glue", "default"), ("logs", "aws.glue_x", "default"),
         ("metrics", "aws.glue", "default"), ("logs", "aws.codebuild", "default")],
        "type string, dataset string, namespace string",
    )

    def hits(pattern):
        return df.filter(docs.index_pattern(pattern)).count()

    assert hits("logs-aws.glue*") == 2 and hits("logs-aws.glue") == 1
    assert hits("logs-aws.*") == 3 and hits("logs-aws.g*e-default") == 1
    assert hits("logs-aws.codebuild*,metrics-aws.glue*") == 2


def test_streams_are_written_and_pruned(rows, spark, tmp_path):
    df = rows(
        [(i, "logs", "aws.glue" if i % 3 else "aws.rds") for i in range(30)],
        "id int, stream_type string, stream_dataset string",
    ).withColumns({"stream_namespace": F.lit("default"), "ts": F.timestamp_seconds("id")})
    root = str(tmp_path / "s")
    sinks.write_data_stream(df, root, max_records=7)
    scan = docs.scan_index(spark, root, "logs-aws.gl*")
    assert scan.count() == 20
    assert all("dataset=aws.glue" in f for f in scan.inputFiles())
    typed = docs.scan_index(spark, root, "logs-aws.glue", "id int, ts timestamp, date date")
    assert typed.count() == 20 and set(typed.columns) == set(scan.columns)
    assert docs.scan_index(spark, root, "logs-aws.glue-default,logs-aws.rds-*").count() == 30
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "StartsWith(dataset" in plan
    start, end = F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(20))
    assert filters.time_range(scan, start, end).count() == len([i for i in range(10, 20) if i % 3])


def test_bulk_lines(rows):
    df = rows([(1, None), (2, "x")], "id int, note string")
    out = [r["value"].split("\n") for r in sinks.bulk_lines(df, F.lit("logs-aws.x-default")).collect()]
    assert json.loads(out[0][0]) == {"create": {"_index": "logs-aws.x-default"}}
    assert json.loads(out[0][1]) == {"id": 1} and json.loads(out[1][1]) == {"id": 2, "note": "x"}


def test_append_create_only(rows):
    new = rows([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    old = rows([(2,), (2,)], "k int")
    out = sinks.append_create_only(new, old, ["k"], ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (3, "d")]
    pairs = rows([("a", None, 1), ("a", None, 2), ("b", None, 3)], "x string, y string, v int")
    kept = sinks.append_create_only(pairs, pairs.filter("x = 'a'"), ["x", "y"], ["v"])
    assert kept.collect() == [("b", None, 3)]


def test_ingest_outcomes(rows):
    df = rows(
        [("d", 3, "mapper", "late reason"), ("d", 1, sinks.CONFLICT, "dup"), ("d", 2, "mapper", "x" * 200),
         ("d", 4, None, None), ("ok", 5, None, None)],
        "dataset string, seq int, error_type string, error_reason string",
    )
    out = {r["dataset"]: r for r in sinks.ingest_outcomes(df).collect()}
    assert tuple(out["d"])[1:5] == (1, 1, 2, "mapper") and out["d"]["first_error_reason"] == "x" * 200
    assert tuple(out["ok"])[1:] == (1, 0, 0, None, None)


def test_quarantine_names_the_first_broken_rule(rows):
    df = rows([(1, 1), (None, 5), (9, 9)], "a int, b int")
    rules = [sinks.Rule("a", F.col("a") < 5), sinks.Rule("b", F.col("b") < 5)]
    good, bad = sinks.quarantine(df, rules)
    assert good.count() == 1
    assert sorted(r["error_type"] for r in bad.collect()) == ["a", "a"]


def test_pick_handles_dots_spaces_and_promoted_columns(rows):
    df = rows([('{"svc":{"Cluster Name":"c","a.b":1.5,"job":{"name":"j"}}}',)], "t string").select(
        F.try_parse_json("t").alias("aws")
    )
    assert one(df.select(pick(df, ["aws", "svc", "Cluster Name"])))[0] == "c"
    assert one(df.select(pick(df, ["aws", "svc", "a.b"], "double")))[0] == 1.5
    assert one(df.select(pick(df, "aws.svc.nothing")))[0] is None
    assert one(df.select(pick(df, "no.such.field")))[0] is None
    wide = promote(df, {"aws.svc.job.name": "string"}).drop("aws")
    assert one(wide.select(pick(wide, "aws.svc.job.name")))[0] == "j"


def test_session_folder(spark, monkeypatch):
    from skyledger import session

    class Bare:
        """A session in which nobody named the shared folder."""

        class sparkContext:  # noqa: N801
            master = "local[4]"
            getCheckpointDir = staticmethod(lambda: "x")

        class conf:  # noqa: N801
            kept: dict = {}
            get = staticmethod(lambda key, default=None: Bare.conf.kept.get(key, default))
            set = staticmethod(lambda key, value: Bare.conf.kept.update({key: value}))

    first = session.shared_dir(Bare)
    assert session.shared_dir(Bare) == first == Bare.conf.kept[session.SHARED_DIR]
    monkeypatch.setattr(Bare.sparkContext, "master", "local-cluster[3,2,1000]")
    Bare.conf.kept = {}
    with pytest.raises(RuntimeError):
        session.shared_dir(Bare)
    Bare.conf.kept = {session.SHARED_DIR: "file:///shared"}
    assert session.shared_dir(Bare) == "file:///shared"


def test_read_documents_keeps_every_line(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"x": {i}}}\n' for i in range(3)))
    assert docs.read_documents(spark, str(tmp_path)).count() == 3


def test_read_documents_and_logs(spark, tmp_path):
    doc = {"@timestamp": "2024-01-01T00:00:00.500Z", "event": {"category": "web", "outcome": "success"},
           "aws": {"x": {"y": 1}}, "message": "m"}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = one(docs.read_documents(spark, str(tmp_path), multi_line=True).select(
        F.try_variant_get("doc", "$.aws.x.y", "int").alias("y")))
    assert got["y"] == 1
    log = one(docs.read_logs(spark, str(tmp_path), multi_line=True))
    assert log["event"]["category"] == ["web"] and log["ts"].microsecond == 500000


def test_scalars(rows):
    df = rows([("arn:aws:s3:::b:c/d", 6, 799)], "a string, p int, n int")
    a = F.col("a")
    out = one(df.select(
        X.arn_part(a, 6).alias("r"), X.last_segment(a).alias("l"),
        X.protocol_name(F.col("p")).alias("t"), X.protocol_name(F.lit(99)).alias("u"),
        X.billed_millis(F.col("n")).alias("b"), X.name_uuid(F.lit("x")).alias("id"),
        X.parse_time(F.lit("nonsense")).alias("bad"),
    ))
    assert (out["r"], out["l"], out["t"], out["u"], out["b"]) == ("b:c/d", "d", "tcp", "tcp", 800)
    assert out["bad"] is None and len(out["id"]) == 36 and out["id"][14] == "4" and out["id"][19] in "89ab"

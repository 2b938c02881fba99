"""Message parsing: every kind of line and the rename rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyledger.functions import scalars
from skyledger.operators import parse
from skyledger.plans import parsers

REPORT = (
    "REPORT RequestId: r1\tDuration: 12.50 ms\tBilled Duration: 100 ms\tMemory Size: 512 MB"
    "\tMax Memory Used: 80 MB"
)


def parsed(rows, messages, dataset="aws.lambda_logs", **more):
    df = rows([(i, m, dataset) for i, m in enumerate(messages)], "id int, message string, dataset string")
    return {r["id"]: r for r in parse.parse_documents(df, parsers.all_parsers(), **more).collect()}


def test_catalogue_size_and_groups():
    every = parsers.all_parsers()
    assert len(every) == 187 and len({p.name for p in every}) == 187
    assert len(parsers.WITH_MOVES) == 14
    assert parsers.group_names() == sorted(parsers.group_names()) and len(parsers.group_names()) == 15
    assert {p.group for p in parsers.parsers_of(["iot"])} == {"iot"}
    assert sum(len(p.renames) for p in every) == 54
    assert sum(len(p.lower) for p in every) == 4
    ec2 = next(p for p in every if p.dataset == "aws.ec2_logs")
    assert ec2.namespace == "ec2.parsed"


def test_json_accepts_any_value_and_keeps_plain_text(rows):
    out = parsed(rows, ['{"a":1}', "plain", "3", "[1]", "", None], dataset="aws.kms")
    assert len(out) == 6
    assert [out[i]["parsed"] is not None for i in range(6)] == [True, False, True, True, False, False]


def test_nothing_may_follow_the_json_value(rows):
    bad = ["2 1234 eni-1", '{"a":1} {"b":2}', '{"a":1}}', '{"a":1}],[{"b":2}', "1],[2", "1,2", '1,"v":2',
           '"x" y', "NaN", '{"a":1', "- 1", "tru", "{}{}", '{"a":1},"b":{}']
    good = [' {"a":{"b":[1,{}]}} ', "[ ]", "-1.5e3", "true", "null", '"a b"', "{}", '{"a":"}],["}']
    out = parsed(rows, bad + good, dataset="aws.kms")
    assert [m for i, m in enumerate(bad) if out[i]["parsed"] is not None] == []
    assert [m for i, m in enumerate(good, len(bad)) if out[i]["parsed"] is None] == []


def test_messages_are_told_by_their_ends(rows):
    """An object or list in bare brackets is not read by the pattern; padded ones, texts and numbers still are."""
    good = ['{"a":"\u2028\\n"}', "[]", ' \t\r\n{"a":\n1}\n', '"\u00e9\n"'.replace("\n", ""), "-0.5", "0"]
    bad = ["{", "[", "{]", "[}", '"', "{a}", "\x0b{}", "{}\x0c", "{}\u2028", "\u00a0[]", '{"a":1}\x00', "[1]]", "01"]
    out = parsed(rows, good + bad, dataset="aws.kms")
    assert [out[i]["parsed"] is not None for i in range(len(good + bad))] == [True] * len(good) + [False] * len(bad)
    shape = str(scalars._json_shape(F.col("m"))).lower()
    assert "startswith" in shape.split("rlike")[0] and "rlike" in shape


def test_namespace_of_every_dataset(rows):
    every = parsers.all_parsers()
    odd = [parse.Parser("own.kms", "g", "kms.parsed"), parse.Parser("plain", "g", "plain.parsed")]
    asked = [(p.dataset,) for p in every + odd] + [("aws.none",), (None,)]
    got = rows(asked, "d string").select("d", parse._namespace(F.col("d"), every + odd).alias("space")).collect()
    assert {r["d"]: r["space"] for r in got} == {p.dataset: p.namespace for p in every + odd} | {
        "aws.none": None, None: None,
    }
    assert rows([("a",)], "d string").select(F.isnull(parse._namespace(F.col("d"), odd))).first()[0]


def test_datasets_without_parser_pass_through(rows):
    out = parsed(rows, ['{"a":1}'], dataset="own.dataset")
    assert out[0]["parsed_as"] is None and out[0]["parsed"] is None


def test_function_lines(rows):
    out = parsed(
        rows,
        [REPORT, REPORT.replace("\t", " "), "START RequestId: r2 Version: $LATEST",
         "END RequestId: r3", '{"requestId":"r4"}'],
    )
    for i in (0, 1):
        assert out[i]["lambda__requestId"] == "r1"
        assert out[i]["lambda__durationMs"] == 12.5
        assert out[i]["lambda__billedDurationMs"] == 100.0
        assert (out[i]["lambda__memorySizeMB"], out[i]["lambda__maxMemoryUsedMB"]) == (512, 80)
    assert out[2]["lambda__requestId"] == "r2" and out[2]["lambda__durationMs"] is None
    # A lazy capture at the end of a pattern takes the empty text.
    assert out[2]["lambda__version"] == "" and out[3]["lambda__requestId"] == ""
    assert out[4]["lambda__requestId"] is None and out[4]["parsed"] is not None


@pytest.mark.parametrize(
    "mode,want", [("keep_target", ["info", "warn", "info"]), ("overwrite", ["warn", "warn", "info"])]
)
def test_rename_conflicts(rows, mode, want):
    df = rows(
        [(0, '{"level":"WARN"}', "info"), (1, '{"level":"WARN"}', None), (2, "{}", "info")],
        "id int, message string, level string",
    ).withColumn("dataset", F.lit("aws.glue"))
    out = parse.parse_documents(
        df, parsers.all_parsers(), existing={"log.level": "level"}, on_conflict=mode
    )
    assert [r["log__level"] for r in out.orderBy("id").collect()] == want


def test_renames_of_scalars_do_nothing(rows):
    out = parsed(rows, ["3", "[1]"], dataset="aws.glue")
    assert out[0]["glue__jobName"] is None and out[1]["glue__jobName"] is None


def test_flow_record(rows):
    line = "2 123 eni-1 10.0.0.1 10.0.0.2 443 50000 6 10 1500 1700000000 1700000060 ACCEPT OK"
    df = rows([(line,), ("3 other version",), (line.replace(" 443 ", " - "),), (None,)], "m string")
    out = [r[0] for r in df.select(parse.flow_record(F.col("m"))).collect()]
    assert (out[0]["srcaddr"], out[0]["bytes"], out[0]["end"]) == ("10.0.0.1", 1500, 1700000060)
    assert out[1] is None and out[3] is None and out[2]["srcport"] is None


def test_other_lines(rows):
    df = rows(
        [("[WARN]\trid\tslow query",), (REPORT + "\tInit Duration: 210.25 ms",),
         ("GET /a/b 404 17ms",), ("GET /a 200 [Hit]",),
         ("2024-01-01T00:00:00Z Q1 ip4 10.0.0.1 53 A example.com. NXDOMAIN",)],
        "m string",
    )
    m = F.col("m")
    out = df.select(
        parse.function_app_line(m).alias("app"), parse.init_duration(m).alias("init"),
        parse.http_access_line(m).alias("http"), parse.dns_query_line(m).alias("dns"),
    ).collect()
    assert tuple(out[0]["app"]) == ("warn", "rid", "slow query")
    assert out[1]["init"] == 210.25 and out[0]["init"] is None
    assert tuple(out[2]["http"]) == ("GET", "/a/b", 404, 17, None)
    assert tuple(out[3]["http"]) == ("GET", "/a", 200, None, "Hit")
    assert (out[4]["dns"]["name"], out[4]["dns"]["response_code"]) == ("example.com", "NXDOMAIN")


def test_embedded_json(rows):
    df = rows([('{"a":1}',), ("null",), ("oops",), (None,)], "t string")
    out = df.select(parse.embedded_json(F.col("t")).isNotNull().alias("x")).collect()
    assert [r["x"] for r in out] == [True, False, False, False]

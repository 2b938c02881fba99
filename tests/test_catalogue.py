"""Every registered query: comparison with its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import check
import duckdb
import pytest

import __spark_entry__ as entry
from skyledger import catalog

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.queries())
    assert sum(n.startswith("panel_") for n in NAMES) >= 58
    assert not any(re.match(r"op\d", n) or "pipeline" in n for n in NAMES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["name", "count", "avg_duration"] and out.count() == 5


HEAVY = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow",
    "RoundRobinPartitioning",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    """Every query gives what its SQL gives, without cross joins, Python rows or blind reshuffles."""
    plans = []
    text, _, good = check.compare(spark, con, name, SF, plans.append)
    assert good, text
    assert not [h for h in HEAVY if h in plans[0]]


def test_outer_lookup_keeps_its_salt(spark):
    from pyspark.sql import functions as F

    from skyledger.operators.joins import lookup_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100).select(
            F.when(F.col("id") < 10, F.col("id")).alias("k"), F.col("id").alias("x")
        )
        right = spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("y"))
        out = lookup_join(left, right, ["k"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+L, _salt", plan)
        assert out.count() == 100 and out.filter("y = 1").count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_time_and_column_pushdown(spark):
    plan = entry.queries()["filter_time_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_promoted_fields_are_read_alone(spark):
    plan = entry.queries()["panel_on_promoted_fields"](spark, SF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<dataset:string,aws__glue__job__run_state:string>" in text

"""The documented dashboard panels over events: one query per panel.

Event types stand for the four datasets. Documents carry the panel fields in a VARIANT tail, so
the panels resolve their fields exactly as they would on stored documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skyledger.catalog.base import (
    EV, bucket_sql, columns_sql, documents, events, query, r4, r4_sql, secs, secs_sql,
)
from skyledger.functions.fields import promote
from skyledger.plans import dashboards, panels
from skyledger.plans.panels import Panel
from skyledger.session import scratch_path

DATASET = (
    "CASE event_type WHEN 'click' THEN 'aws.glue' WHEN 'view' THEN 'aws.emr_logs' "
    "WHEN 'purchase' THEN 'aws.athena' WHEN 'signup' THEN 'aws.sagemaker' ELSE 'aws.lambda_logs' END"
)
STATE = "CASE WHEN k < 20 THEN 'FAILED' WHEN k < 30 THEN 'STOPPED' ELSE 'SUCCEEDED' END"
CATEGORY = "CASE WHEN k < 20 THEN concat('cat-', CAST(k AS VARCHAR(9))) END"
NUMBERS = ["v", "k", "u", "v * 10", "k * 100", "k / 100.0"]


def _fields() -> dict[str, str]:
    """Every field a panel reads, as an SQL snippet that both engines understand."""
    fields = {
        "event.outcome": "CASE WHEN k < 20 THEN 'failure' ELSE 'success' END",
        "event.duration": "CAST(v * 1e9 AS DOUBLE)",
        "event.action": "concat('act-', CAST(k AS VARCHAR(9)))",
    }
    for panel in panels.PANELS:
        for i, name in enumerate(panels.fields_of(panel)):
            if name in fields:
                continue
            if name.endswith(("run_state", ".state")):
                fields[name] = STATE
            elif name.endswith(("error_category", "error_code")):
                fields[name] = CATEGORY
            elif name.endswith("job.type"):
                fields[name] = "CASE WHEN k < 50 THEN 'Training' ELSE 'Processing' END"
            elif name == panel.by or panel.kind == "recent" and "bytes" not in name and "_mb" not in name:
                fields[name] = "concat('x-', CAST(u AS VARCHAR(9)))"
            else:
                fields[name] = f"CAST({NUMBERS[(len(fields) + i) % len(NUMBERS)]} AS DOUBLE)"
    return fields


FIELDS = _fields()
SPAN, SECONDS = "6 hours", 21600
DOCS = f"{EV}, docs AS (SELECT event_id, ts, {DATASET} AS dataset, {columns_sql(FIELDS)} FROM ev)"


def docs(spark, sf):
    base = events(spark, sf).withColumn("dataset", F.expr(DATASET))
    return documents(base, FIELDS, ["event_id", "ts", "dataset"])


def panel_sql(p: Panel) -> str:
    return f"WITH {DOCS} {body_sql(p)}"


def body_sql(p: Panel) -> str:
    """The panel as SQL, written per kind against the flat columns of ``docs``."""
    names = ", ".join(f"'{d}'" for d in panels.DATASETS[p.dashboard])
    where = f"dataset IN ({names})"
    for name, value in p.where:
        where += f" AND \"{name}\" = '{value}'"
    rows = f"FROM docs WHERE {where}"
    slot = f"{bucket_sql(SECONDS)} AS bucket"
    fn = "avg" if p.kind.startswith("avg") else "sum"
    values = {n: r4_sql(f'{fn}("{f}") / {p.unit!r}') for n, f in p.series}
    listed = ", ".join(f"{v} AS {n}" for n, v in values.items())
    bad = "\"event.outcome\" = 'failure'"
    kinds = {
        "count": f"SELECT count(*) AS value {rows}",
        "failures": f"SELECT count(*) AS value {rows} AND {bad}",
        "success_rate": "SELECT " + r4_sql(
            "100.0 * count(*) FILTER (\"event.outcome\" = 'success') / count(*)"
        ) + f" AS value {rows}",
        "avg": f"SELECT {listed} {rows}",
        "sum": f"SELECT {listed} {rows}",
        "failures_line": f"SELECT {slot}, count(*) FILTER ({bad}) AS value {rows} GROUP BY 1",
        "avg_by": f'SELECT "{p.by}" AS key, {listed} {rows} GROUP BY 1',
        "count_line": f"SELECT {slot}, count(*) AS value {rows} GROUP BY 1",
        "avg_line": f"SELECT {slot}, {listed} {rows} GROUP BY 1",
        "sum_line": f"SELECT {slot}, {listed} {rows} GROUP BY 1",
        "stacked": " UNION ALL ".join(
            f"SELECT {slot}, '{n}' AS series, {v} AS value {rows} GROUP BY 1"
            for n, v in values.items()
        ),
        "share": f'SELECT "{p.by}" AS key, count(*) AS count, '
        + r4_sql("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)")
        + f" AS share {rows} GROUP BY 1",
        "top": f'SELECT "{p.by}" AS key, count(*) AS count {rows} GROUP BY 1 '
        f"ORDER BY 2 DESC, 1 LIMIT {p.n}",
        "failures_by": f'SELECT "{p.by}" AS key, count(*) AS count {rows} AND {bad} GROUP BY 1'
        + (f" ORDER BY 2 DESC, 1 LIMIT {p.n}" if p.n else ""),
        "sum_by": f'SELECT "{p.by}" AS key, {values.get("value", "NULL")} AS value {rows} GROUP BY 1',
        "recent": f"SELECT {secs_sql()} AS at, "
        + ", ".join(
            (r4_sql(f'"{f}"') if n in panels.NUMERIC else f'"{f}"') + f" AS {n}" for n, f in p.series
        )
        + f" {rows} ORDER BY ts DESC, event_id LIMIT {p.n}",
    }
    return kinds[p.kind]


def run(p: Panel, spark, sf):
    df = panels.run(p, docs(spark, sf), SPAN, tie="event_id")
    if "bucket" in df.columns:
        df = df.withColumn("bucket", secs("bucket"))
    if p.kind == "recent":
        df = df.select(secs("ts").alias("at"), *[
            (r4(F.col(n)) if n in panels.NUMERIC else F.col(n)).alias(n) for n, _ in p.series
        ])
    for name, kind in df.dtypes:
        if kind == "double" and p.kind != "recent":
            df = df.withColumn(name, r4(F.col(name)))
    return df


for _panel in panels.PANELS:
    query(f"panel_{_panel.name}", panel_sql(_panel))(partial(run, _panel))


_PROMOTED = panels.by_name("glue_runs_by_state")


@query("panel_on_promoted_fields", panel_sql(_PROMOTED))
def on_promoted_fields(spark, sf):
    """The same panel over a written table whose hot fields are typed columns."""
    path = scratch_path(spark, "promoted")
    promote(docs(spark, sf), panels.hot_fields()).write.parquet(path)
    stored = spark.read.parquet(path).drop("aws")
    out = panels.run(_PROMOTED, stored, SPAN)
    return out.withColumn("share", r4(F.col("share")))


def _titled_fields(name: str) -> dict[str, str]:
    _, dimensions, measures = dashboards.DASHBOARDS[name]
    fields = {
        "event.outcome": FIELDS["event.outcome"],
        "error.message": "CASE event_type WHEN 'purchase' THEN concat('e', CAST(k AS VARCHAR(9))) END",
    }
    for i, field in enumerate(dimensions):
        value = "u" if i == 0 else "k"
        fields[field] = f"concat('x-', CAST({value} AS VARCHAR(9)))"
    for i, field in enumerate(measures):
        fields[field] = f"CAST({NUMBERS[i % len(NUMBERS)]} AS DOUBLE)"
    return fields


def _titled_dataset(name: str) -> str:
    """Errors belong to another dataset; with two datasets clicks go to the second one."""
    names = dashboards.DASHBOARDS[name][0]
    return (
        f"CASE event_type WHEN 'error' THEN 'other' WHEN 'click' THEN '{names[-1]}' "
        f"ELSE '{names[0]}' END"
    )


def _titled_docs_sql(name: str) -> str:
    fields = columns_sql(_titled_fields(name))
    return f"{EV}, docs AS (SELECT event_id, ts, {_titled_dataset(name)} AS dataset, {fields} FROM ev)"


def titled_sql(name: str) -> str:
    parts = []
    for p in dashboards.panels_of(name):
        grouped = p.kind in ("share", "avg_by")
        key = "key" if grouped else "CAST(bucket AS VARCHAR)" if p.kind.endswith("line") else "''"
        named = [n for n, _ in p.series] or ["value"]
        for series in ("count", "share") if p.kind == "share" else named:
            parts.append(
                f"SELECT '{p.key}' AS panel, {key} AS key, '{series}' AS series, "
                f"CAST({series} AS DOUBLE) AS value FROM ({body_sql(p)})"
            )
    return f"WITH {_titled_docs_sql(name)} " + " UNION ALL ".join(parts)


def run_titled(name: str, spark, sf):
    base = events(spark, sf).withColumn("dataset", F.expr(_titled_dataset(name)))
    made = documents(base, _titled_fields(name), ["event_id", "ts", "dataset"])
    return dashboards.run(name, made, SPAN).withColumn("value", r4(F.col("value")))


for _name in dashboards.DASHBOARDS:
    query(f"dashboard_{_name}", titled_sql(_name))(partial(run_titled, _name))


_EVENTS = dashboards.event_table("kinesisanalytics")


@query("dashboard_kinesisanalytics_events", f"WITH {_titled_docs_sql('kinesisanalytics')} {body_sql(_EVENTS)}")
def kinesis_events(spark, sf):
    """The event table of the documented dashboard."""
    name = _EVENTS.dashboard
    base = events(spark, sf).withColumn("dataset", F.expr(_titled_dataset(name)))
    made = documents(base, _titled_fields(name), ["event_id", "ts", "dataset"])
    out = panels.run(_EVENTS, made, SPAN, tie="event_id")
    return out.select(secs("ts").alias("at"), *[
        (r4(F.col(n)) if n in panels.NUMERIC else F.col(n)).alias(n) for n, _ in _EVENTS.series
    ])

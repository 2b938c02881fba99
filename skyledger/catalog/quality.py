"""Q*: data quality over events, documents, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, events, query, r4, r4_sql, table
from skyledger.operators import quality as Q
from skyledger.sources import registry as R
from skyledger.sources.sinks import Rule


def log_documents(spark, sf):
    """Events as documents in which every base field is missing somewhere."""
    k = F.col("k")
    return events(spark, sf).select(
        F.when(k != 1, F.col("ts")).alias("ts"), "event_type", "k",
        F.struct(
            F.when(k < 95, "aws").otherwise("gcp").alias("provider"),
            F.when(k < 90, "us-east-1").alias("region"),
            F.struct(F.when(k < 85, F.col("u").cast("string")).otherwise("").alias("id")).alias(
                "account"
            ),
        ).alias("cloud"),
        F.struct(
            F.when(F.col("event_type") == "error", "failure").when(k < 80, "success").alias("outcome"),
            F.when(k != 2, F.col("v") - 1).alias("duration"),
            F.concat(F.lit("aws."), F.col("event_type")).alias("dataset"),
        ).alias("event"),
        F.when(k >= 5, F.col("props")).alias("message"),
        F.when((F.col("event_type") == "error") & (k < 70), F.struct(F.lit("E").alias("code"))).alias(
            "error"
        ),
        F.when(F.col("event_type") == "view", "aws.custom").otherwise(
            F.concat(F.lit("aws."), "event_type")
        ).alias("stream_dataset"),
    )


BASE = {
    "timestamp": "k = 1",
    "cloud_provider": "k >= 95",
    "cloud_region": "k >= 90",
    "cloud_account": "k >= 85",
    "message": "k < 5",
    "outcome": "event_type <> 'error' AND k >= 80",
    "duration": "k <> 2 AND v - 1 <= 0",
}


def rules_sql(rules: dict[str, str], source: str = "ev") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER ({bad}) AS failed FROM {source}"
        for name, bad in rules.items()
    )


@query("quality_base_contract", f"WITH {EV} {rules_sql(BASE)}")
def base_contract(spark, sf):
    df = log_documents(spark, sf)
    return Q.rule_report(df, Q.base_rules(df))


@query(
    "quality_outcome_consistency",
    f"""WITH {EV} SELECT * FROM (SELECT event_type, count(*) AS checked, 'failure_without_error' AS rule,
          count(*) FILTER (event_type = 'error' AND k >= 70) AS failed FROM ev GROUP BY 1
        UNION ALL SELECT event_type, count(*), 'error_without_failure', 0 FROM ev GROUP BY 1)""",
)
def outcome_consistency(spark, sf):
    df = log_documents(spark, sf)
    outcome = F.coalesce(F.col("event.outcome"), F.lit("unknown"))
    rules = Q.outcome_rules(outcome, F.col("error").isNotNull())
    return Q.rule_report(df, rules, ("event_type",))


@query(
    "quality_null_report",
    f"""WITH {EV} {rules_sql({"ts": "k = 1", "message": "k < 5", "error": "NOT (event_type = 'error' AND k < 70)"})}""",
)
def null_report(spark, sf):
    return Q.null_report(log_documents(spark, sf), ["ts", "message", "error"])


@query(
    "quality_field_coverage",
    f"""WITH {EV} SELECT event_type AS dataset, field, {r4_sql("avg(has)")} AS share FROM (
        SELECT event_type, unnest(['cloud.region', 'event.outcome', 'error.code']) AS field,
          unnest([CASE WHEN k < 90 THEN 1 ELSE 0 END,
            CASE WHEN event_type = 'error' OR k < 80 THEN 1 ELSE 0 END,
            CASE WHEN event_type = 'error' AND k < 70 THEN 1 ELSE 0 END]) AS has FROM ev)
        WHERE (event_type = 'error' AND field IN ('error.code', 'event.outcome'))
          OR (event_type = 'view' AND field = 'cloud.region') GROUP BY 1, 2""",
)
def field_coverage(spark, sf):
    df = log_documents(spark, sf).withColumnRenamed("event_type", "dataset")
    expected = {"error": ["error.code", "event.outcome"], "view": ["cloud.region"]}
    return Q.field_coverage(df, expected).withColumn("share", r4(F.col("share")))


@query(
    "quality_dataset_agreement",
    """SELECT 'aws.view' AS event_dataset, 'aws.custom' AS stream_dataset, count(*) AS docs
       FROM events WHERE event_type = 'view'""",
)
def dataset_agreement(spark, sf):
    return Q.dataset_agreement(
        log_documents(spark, sf), F.col("event.dataset"), F.col("stream_dataset")
    )


@query(
    "quality_registry_gaps",
    "SELECT 'svc-' || c_custkey AS service FROM customer WHERE c_acctbal < 0 OR c_nationkey < 3",
)
def registry_gaps(spark, sf):
    """Q4: customers stand for registered services; some rows lost a dataset or a source."""
    svc = F.concat(F.lit("svc-"), "c_custkey")
    holes = table(spark, sf, "customer").select(
        svc.alias("service"), F.when(F.col("c_acctbal") >= 0, R.logs_dataset(svc)).alias("logs_dataset"),
        R.metrics_dataset(svc).alias("metrics_dataset"),
        F.when(F.col("c_nationkey") >= 3, R.default_source(svc)).alias("default_source"),
    )
    return Q.registry_gaps(holes)


@query(
    "quality_document_contract",
    rules_sql(
        {
            "text": "text IS NULL OR length(text) = 0",
            "n_chars": "n_chars <> length(text)",
            "long_enough": "length(text) < 200",
            "source": "source IS NULL",
        },
        "documents",
    ),
)
def document_contract(spark, sf):
    """Q1 over whole texts."""
    rules = [
        Rule("text", F.length("text") > 0),
        Rule("n_chars", F.col("n_chars") == F.length("text")),
        Rule("long_enough", F.length("text") >= 200),
        Rule("source", F.col("source").isNotNull()),
    ]
    return Q.rule_report(table(spark, sf, "documents"), rules)


# Every event as a document of unknown layout.
SHAPED_SPARK = """concat('{"cloud":{"region":', CASE WHEN k < 90 THEN '"r"' ELSE 'null' END, '},"k":',
    CASE WHEN event_type = 'error' THEN concat('"', k, '"') ELSE CAST(k AS STRING) END, ',"items":[{"id":1},{"id":2',
    CASE WHEN k % 4 = 0 THEN ',"price":2.5' ELSE '' END, '}],"tags":["a",null]',
    CASE WHEN event_type = 'view' THEN ',"deep":{"er":{"still":{"x":true}}}' ELSE '' END, ',"none":null}')"""
PATHS_SQL = f"""{EV}, pa AS (SELECT event_type AS dataset, unnest([
    {{'f': 'cloud.region', 'has': k < 90, 'kind': 'STRING'}},
    {{'f': 'k', 'has': true, 'kind': CASE WHEN event_type = 'error' THEN 'STRING' ELSE 'BIGINT' END}},
    {{'f': 'items', 'has': true, 'kind': 'ARRAY'}}, {{'f': 'items[].id', 'has': true, 'kind': 'BIGINT'}},
    {{'f': 'items[].price', 'has': k % 4 = 0, 'kind': 'DECIMAL'}}, {{'f': 'tags', 'has': true, 'kind': 'ARRAY'}},
    {{'f': 'deep.er.still.x', 'has': event_type = 'view', 'kind': 'BOOLEAN'}}], recursive := true) FROM ev),
  paths AS (SELECT dataset, f AS field, count(*) FILTER (has) AS docs, count(*) AS total, max(kind) AS kinds
    FROM pa GROUP BY 1, 2 HAVING count(*) FILTER (has) > 0)"""


def shaped_documents(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("dataset"), F.try_parse_json(F.expr(SHAPED_SPARK)).alias("doc")
    )


@query("quality_field_paths", f"WITH {PATHS_SQL} SELECT dataset, field, docs, total, kinds FROM paths")
def field_paths(spark, sf):
    """Q8: every path that documents of unknown layout hold."""
    out = Q.field_paths(shaped_documents(spark, sf))
    return out.select("dataset", "field", "docs", "total", F.array_join("kinds", ",").alias("kinds"))


EXPECTED_FIELDS = [
    ("view", "cloud.region"), ("view", "deep.er.still.x"), ("view", "host.name"),
    ("error", "k"), ("error", "error.code"), ("error", "items"), ("click", "tags"),
]


@query(
    "quality_field_gaps",
    f"""WITH {PATHS_SQL}, want AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{f}')" for d, f in EXPECTED_FIELDS)})
          AS w(dataset, field)),
        known AS (SELECT * FROM paths WHERE dataset IN (SELECT dataset FROM want))
        SELECT coalesce(p.dataset, w.dataset) AS dataset, coalesce(p.field, w.field) AS field,
          CASE WHEN w.field IS NULL THEN 'unexpected' WHEN p.field IS NULL THEN 'missing' ELSE 'present' END AS status,
          coalesce(docs, 0) AS docs, {r4_sql("coalesce(docs / CAST(total AS DOUBLE), 0)")} AS share
        FROM known p FULL JOIN want w ON w.dataset = p.dataset AND w.field = p.field""",
)
def field_gaps(spark, sf):
    """Q8: fields that are expected but absent, and present but not expected."""
    expected = spark.createDataFrame(EXPECTED_FIELDS, "dataset string, field string")
    out = Q.field_gaps(Q.field_paths(shaped_documents(spark, sf)), expected)
    return out.withColumn("share", r4(F.col("share")))

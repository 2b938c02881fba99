"""M*: metric documents over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql
from skyledger.operators import metrics as M
from skyledger.operators import stats as A


REGION = "CASE WHEN k % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END"
ACCOUNT = "CASE WHEN k < 80 THEN 'a' || CAST(k % 3 AS VARCHAR(9)) END"


def place():
    """Two regions and three accounts, one of them unknown at times."""
    return F.expr(REGION).alias("region"), F.expr(ACCOUNT).alias("account_id")


def metric_documents(spark, sf):
    """One metric document per event: three metrics, one with a dot in its name."""
    stat = lambda x: F.struct(x.alias("avg"), x.alias("sum"), F.lit(1).alias("count"))
    failed = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    body = F.struct(
        F.struct(
            F.struct(
                stat(F.col("v")).alias("GetRecords.Bytes"), stat(failed).alias("Errors"),
                F.struct(
                    F.lit(1.0).alias("avg"), F.lit(1.0).alias("sum"), F.lit(1).alias("count"),
                    F.col("v").alias("max"), F.col("v").alias("min"),
                ).alias("Invocations"),
            ).alias("metrics"),
            F.struct(
                F.concat(F.lit("fn-"), "u").alias("FunctionName"),
                F.col("event_type").alias("Cluster Name"),
            ).alias("dimensions"),
        ).alias("lambda")
    )
    return events(spark, sf).select(
        "event_id", "ts", F.lit("aws.lambda").alias("dataset"), *place(),
        F.to_variant_object(body).alias("aws"),
    )


def rows(spark, sf):
    return M.explode_metrics(metric_documents(spark, sf))


@query(
    "metrics_explode",
    f"""WITH {EV} SELECT event_id, metric, 'fn-' || u AS fn, event_type AS cluster,
        CAST(CASE metric WHEN 'Errors' THEN CASE WHEN event_type = 'error' THEN 1 ELSE 0 END
          WHEN 'Invocations' THEN 1 ELSE v END AS DOUBLE) AS sum, CAST(1 AS BIGINT) AS count,
        CASE WHEN metric = 'Invocations' THEN v END AS max
        FROM ev, unnest(['Errors', 'GetRecords.Bytes', 'Invocations']) AS m(metric)""",
)
def explode(spark, sf):
    return rows(spark, sf).select(
        "event_id", "metric", F.try_element_at("dimensions", F.lit("FunctionName")).alias("fn"),
        F.try_element_at("dimensions", F.lit("Cluster Name")).alias("cluster"),
        "sum", "count", "max",
    )


@query(
    "metrics_by_dimension",
    f"""WITH {EV} SELECT event_type AS cluster, 'Errors' AS metric,
        {r4_sql("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)")} AS sum FROM ev GROUP BY 1
        UNION ALL SELECT event_type, 'GetRecords.Bytes', {r4_sql("sum(v)")} FROM ev GROUP BY 1
        UNION ALL SELECT event_type, 'Invocations', {r4_sql("count(*)")} FROM ev GROUP BY 1""",
)
def by_dimension(spark, sf):
    out = M.by_dimension(rows(spark, sf), "Cluster Name")
    return out.groupBy(F.col("dim_Cluster Name").alias("cluster"), "metric").agg(
        r4(F.sum("sum")).alias("sum")
    )


@query(
    "metrics_rollup_documents",
    f"""WITH {EV}, m AS (SELECT *, {REGION} AS region, {ACCOUNT} AS account_id, metric,
          CAST(CASE metric WHEN 'Errors' THEN CASE WHEN event_type = 'error' THEN 1 ELSE 0 END
            WHEN 'Invocations' THEN 1 ELSE v END AS DOUBLE) AS x
          FROM ev, unnest(['Errors', 'GetRecords.Bytes', 'Invocations']) AS t(metric))
        SELECT metric, region, account_id, event_type AS cluster, {bucket_sql(3600)} AS bucket,
        {r4_sql("sum(x)")} AS sum, count(*) AS count, {r4_sql("avg(x)")} AS avg FROM m
        GROUP BY 1, 2, 3, 4, 5""",
)
def rollup_documents(spark, sf):
    """M2: from single documents to hours, keeping one of two dimensions."""
    out = M.rollup(rows(spark, sf), "1 hour", keep=["Cluster Name"])
    return out.select(
        "metric", "region", "account_id", F.col("dim_Cluster Name").alias("cluster"), secs("bucket").alias("bucket"),
        r4(F.col("sum")).alias("sum"), "count", r4(F.col("avg")).alias("avg"),
    )


@query(
    "metrics_pivot",
    f"""WITH {EV} SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE)
        AS "Errors", CAST(1 AS DOUBLE) AS "Invocations" FROM ev""",
)
def pivot(spark, sf):
    return M.to_wide(rows(spark, sf), ["event_id"], ["Errors", "Invocations"])


@query(
    "metrics_dedup",
    f"""WITH {EV} SELECT u, event_type, {REGION} AS region, {ACCOUNT} AS account_id,
        {bucket_sql(86400)} AS day, min(event_id) AS event_id FROM ev GROUP BY 1, 2, 3, 4, 5""",
)
def dedup(spark, sf):
    """M5: the key does not depend on the order of the dimension entries."""
    u, kind = F.col("u").cast("string"), F.col("event_type")
    one = F.create_map(F.lit("a"), u, F.lit("b"), kind)
    other = F.create_map(F.lit("b"), kind, F.lit("a"), u)
    df = events(spark, sf).select(
        "event_id", "u", "event_type", A.bucket(F.col("ts"), "1 day").alias("ts"),
        F.lit("aws.lambda").alias("dataset"), F.lit("Duration").alias("metric"), *place(),
        F.when(F.col("k") < 50, one).otherwise(other).alias("dimensions"),
    )
    out = M.dedup(df, ["event_id"])
    return out.select(
        "u", "event_type", "region", "account_id", secs("ts").alias("day"), "event_id"
    )


@query(
    "metrics_ratio",
    f"""WITH {EV} SELECT u, {r4_sql("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)")}
        AS numerator, {r4_sql("count(*)")} AS denominator,
        {r4_sql("avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)")} AS ratio
        FROM ev GROUP BY 1""",
)
def ratio(spark, sf):
    fn = F.substring(F.try_element_at("dimensions", F.lit("FunctionName")), 4, 20)
    out = M.ratio(rows(spark, sf), [fn.cast("bigint").alias("u")], "Errors", "Invocations")
    return out.select("u", *[r4(F.col(c)).alias(c) for c in ("numerator", "denominator", "ratio")])


@query(
    "metrics_accept_window",
    f"""WITH {EV} SELECT verdict, count(*) AS n, max({secs_sql()}) AS newest FROM (
        SELECT ts, CASE WHEN k <= 40 THEN 'in_time' ELSE 'timestamp_out_of_range' END AS verdict
        FROM ev) GROUP BY 1""",
)
def window_check(spark, sf):
    """M7: documents arrive k * 3 minutes after their time; exactly two hours is in time."""
    late = F.make_interval(mins=F.col("k") * 3)
    good, bad = M.split_late(events(spark, sf), F.col("ts") + late)
    both = good.select("ts", F.lit("in_time").alias("verdict")).unionByName(
        bad.select("ts", F.col("error_type").alias("verdict"))
    )
    return both.groupBy("verdict").agg(F.count("*").alias("n"), F.max(secs("ts")).alias("newest"))

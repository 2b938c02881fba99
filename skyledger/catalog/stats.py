"""A*, W*, O*, U*: aggregations over events, line items, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import (
    EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql, table,
)
from skyledger.operators import filters, metrics, quantiles
from skyledger.operators import sketches as S
from skyledger.operators import stats as A
from skyledger.sources import documents as Docs

OUT = "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END"


def logs(spark, sf):
    """Events as log rows: error events are failures, value is the duration in seconds."""
    return events(spark, sf).withColumn(
        "outcome", F.when(F.col("event_type") == "error", "failure").otherwise("success")
    )


def items(spark, sf):
    return table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))


@query(
    "stats_transactions_by_name",
    f"""WITH {EV} SELECT event_type AS name, count(*) AS count, {r4_sql("avg(v)")} AS avg_duration
        FROM ev GROUP BY 1 ORDER BY count DESC, name""",
)
def transactions_by_name(spark, sf):
    out = A.stats_by(logs(spark, sf), ["event_type"], F.col("v"))
    return out.select(
        F.col("event_type").alias("name"), "count", r4(F.col("avg")).alias("avg_duration")
    )


@query("stats_total", "SELECT count(*) AS value FROM events")
def total(spark, sf):
    return A.total(logs(spark, sf))


@query("stats_failures", "SELECT count(*) AS value FROM events WHERE event_type = 'error'")
def failures(spark, sf):
    df = logs(spark, sf)
    return A.failures(df, F.col("outcome"))


@query(
    "stats_success_rate",
    f"""SELECT {r4_sql("100.0 * count(*) FILTER (event_type <> 'error') / count(*)")} AS value
        FROM events""",
)
def success_rate(spark, sf):
    return logs(spark, sf).agg(r4(A.success_rate(F.col("outcome"))).alias("value"))


@query("stats_avg_seconds", f"SELECT {r4_sql('avg(value)')} AS value FROM events")
def avg_seconds(spark, sf):
    return logs(spark, sf).agg(r4(A.avg_seconds(F.col("v") * 1e9)).alias("value"))


@query(
    "stats_sum_gb",
    f"SELECT {r4_sql('sum(l_extendedprice * 1048576) / (1024.0 * 1024 * 1024)')} AS value FROM lineitem",
)
def sum_gb(spark, sf):
    price = F.col("l_extendedprice") * 1048576
    return items(spark, sf).agg(r4(A.sum_in(price, 1024**3)).alias("value"))


@query(
    "stats_share",
    f"""SELECT event_type, count(*) AS count,
        {r4_sql("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)")} AS share
        FROM events GROUP BY 1""",
)
def share(spark, sf):
    return A.share_of(logs(spark, sf), "event_type").withColumn("share", r4(F.col("share")))


@query(
    "stats_top_users",
    "SELECT user_id AS u, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_users(spark, sf):
    return A.top(logs(spark, sf), "u", 10)


@query(
    "stats_failures_by_category",
    f"WITH {EV} SELECT k, count(*) AS count FROM ev WHERE event_type = 'error' GROUP BY 1",
)
def failures_by_category(spark, sf):
    return A.failures_by(logs(spark, sf), F.col("outcome"), "k")


@query(
    "stats_over_time",
    f"""WITH {EV} SELECT {bucket_sql(3600)} AS bucket, count(*) AS n, {r4_sql("avg(v)")} AS avg_v,
        {r4_sql("sum(v)")} AS sum_v FROM ev GROUP BY 1""",
)
def over_time(spark, sf):
    df = A.over_time(
        logs(spark, sf), "1 hour", n=F.count("*"), avg_v=r4(F.avg("v")), sum_v=r4(F.sum("v"))
    )
    return df.withColumn("bucket", secs("bucket"))


@query(
    "stats_two_series_daily",
    f"""SELECT {bucket_sql(86400, "l_shipdate")} AS bucket, {r4_sql("avg(l_discount)")} AS discount,
        {r4_sql("avg(l_tax)")} AS tax FROM lineitem GROUP BY 1""",
)
def two_series(spark, sf):
    df = A.over_time(
        items(spark, sf), "1 day", discount=r4(F.avg("l_discount")), tax=r4(F.avg("l_tax"))
    )
    return df.withColumn("bucket", secs("bucket"))


@query(
    "stats_stacked",
    f"""WITH {EV}, w AS (SELECT {bucket_sql(86400)} AS bucket,
          sum(CASE WHEN event_type = 'error' THEN v ELSE 0 END) AS failed,
          sum(CASE WHEN event_type <> 'error' THEN v ELSE 0 END) AS completed FROM ev GROUP BY 1)
        SELECT bucket, 'failed' AS series, {r4_sql("failed")} AS value FROM w
        UNION ALL SELECT bucket, 'completed', {r4_sql("completed")} FROM w""",
)
def stacked(spark, sf):
    bad = F.col("outcome") == "failure"
    df = A.stacked(
        logs(spark, sf), "1 day",
        failed=F.sum(F.when(bad, F.col("v")).otherwise(0)),
        completed=F.sum(F.when(~bad, F.col("v")).otherwise(0)),
    )
    return df.select(secs("bucket").alias("bucket"), "series", r4(F.col("value")).alias("value"))


@query(
    "stats_sum_by",
    f"""SELECT l_returnflag, {r4_sql("sum(l_quantity) / 1024.0")} AS value
        FROM lineitem GROUP BY 1""",
)
def sum_by(spark, sf):
    out = A.sum_by(items(spark, sf), "l_returnflag", F.col("l_quantity"), 1024)
    return out.withColumn("value", r4(F.col("value")))


@query(
    "stats_two_keys",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS count, {r4_sql("avg(l_quantity)")} AS avg
        FROM lineitem GROUP BY 1, 2 ORDER BY count DESC, 1, 2""",
)
def two_keys(spark, sf):
    out = A.stats_by(items(spark, sf), ["l_returnflag", "l_linestatus"], F.col("l_quantity"))
    return out.withColumn("avg", r4(F.col("avg")))


@query(
    "stats_merge",
    f"""WITH {EV} SELECT u, {bucket_sql(86400)} AS bucket, {r4_sql("sum(v)")} AS sum,
        count(*) AS count, max(v) AS max, min(v) AS min, {r4_sql("avg(v)")} AS avg
        FROM ev GROUP BY 1, 2""",
)
def merge(spark, sf):
    """Hourly (sum, count, max, min) rows merged to days equal the direct aggregate."""
    hourly = (
        events(spark, sf)
        .groupBy("u", A.bucket(F.col("ts"), "1 hour").alias("ts"))
        .agg(
            F.sum("v").alias("sum"), F.count("*").alias("count"),
            F.max("v").alias("max"), F.min("v").alias("min"),
        )
    )
    out = A.merge_stats(hourly, ["u", A.bucket(F.col("ts"), "1 day").alias("bucket")])
    return out.withColumns(
        {"bucket": secs("bucket"), "sum": r4(F.col("sum")), "avg": r4(F.col("avg"))}
    )


@query(
    "stats_detector_inputs",
    f"""WITH {EV} SELECT event_type, {bucket_sql(21600)} AS bucket, count(*) AS n,
        {r4_sql("avg(v)")} AS mean, {r4_sql("sum(v)")} AS total, max(v) AS peak
        FROM ev GROUP BY 1, 2""",
)
def detector_inputs(spark, sf):
    slot = A.bucket(F.col("ts"), "6 hours").alias("bucket")
    out = events(spark, sf).groupBy("event_type", slot).agg(
        F.count("*").alias("n"), r4(F.avg("v")).alias("mean"),
        r4(F.sum("v")).alias("total"), F.max("v").alias("peak"),
    )
    return out.withColumn("bucket", secs("bucket"))


@query(
    "stats_first_seen",
    f"""WITH {EV} SELECT k, {secs_sql("min(ts)")} AS first_seen,
        count(DISTINCT {bucket_sql(900)}) AS buckets FROM ev GROUP BY 1""",
)
def first_seen(spark, sf):
    out = A.first_seen(events(spark, sf), "k")
    return out.withColumn("first_seen", secs("first_seen"))


@query(
    "stats_exact_percentiles",
    f"""SELECT event_type, {r4_sql("quantile_cont(value, 0.5)")} AS p50,
        {r4_sql("quantile_cont(value, 0.95)")} AS p95, {r4_sql("quantile_cont(value, 0.99)")} AS p99
        FROM events GROUP BY 1""",
)
def exact_percentiles(spark, sf):
    out = quantiles.exact_percentiles(logs(spark, sf), ["event_type"], "v", [0.5, 0.95, 0.99])
    return out.select("event_type", *[r4(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "stats_exact_percentiles_lineitem",
    f"""SELECT l_returnflag, {r4_sql("quantile_cont(l_extendedprice, 0.5)")} AS p50,
        {r4_sql("quantile_cont(l_extendedprice, 0.95)")} AS p95 FROM lineitem GROUP BY 1""",
)
def exact_percentiles_items(spark, sf):
    out = quantiles.exact_percentiles(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95]
    )
    return out.select("l_returnflag", *[r4(F.col(c)).alias(c) for c in ("p50", "p95")])


@query(
    "stats_exact_percentiles_null_group",
    f"""SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind,
        {r4_sql("quantile_cont(value, 0.25)")} AS p25, {r4_sql("quantile_cont(value, 1.0)")} AS p100
        FROM events GROUP BY 1""",
)
def exact_percentiles_null_group(spark, sf):
    """Rows without a key are a group, and the largest one here."""
    df = logs(spark, sf).withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    out = quantiles.exact_percentiles(df, ["kind"], "v", [0.25, 1.0])
    return out.select("kind", *[r4(F.col(c)).alias(c) for c in ("p25", "p100")])


@query(
    "stats_approx_percentiles",
    """SELECT event_type, unnest(['p50', 'p95', 'p99']) AS which, true AS within FROM events
       GROUP BY event_type""",
)
def approx_percentiles(spark, sf):
    """The share of values below each sketched percentile is off by at most the promised error."""
    df, accuracy = logs(spark, sf), 1000
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = quantiles.approx_percentiles(df, ["event_type"], "v", list(probs.values()), accuracy)
    sided = df.select("event_type", "v").join(found, "event_type")
    counts = sided.groupBy("event_type").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("v") < F.col(p)).alias(f"below_{p}") for p in probs],
        *[F.count_if(F.col("v") <= F.col(p)).alias(f"upto_{p}") for p in probs],
    )
    slack = F.col("n") / accuracy + 1
    rows = [
        F.struct(
            F.lit(p).alias("which"),
            ((F.col(f"below_{p}") <= q * F.col("n") + slack) & (F.col(f"upto_{p}") >= q * F.col("n") - slack)).alias(
                "within"
            ),
        )
        for p, q in probs.items()
    ]
    return counts.select("event_type", F.explode(F.array(*rows)).alias("r")).select("event_type", "r.*")


@query(
    "stats_volume",
    """SELECT event_type AS dataset, count(*) AS docs, CAST(sum(strlen(props)) AS BIGINT) AS bytes
       FROM events GROUP BY 1""",
)
def volume(spark, sf):
    df = events(spark, sf).withColumnRenamed("event_type", "dataset")
    return A.volume(df, doc=F.col("props"))


@query(
    "window_latest_per_key",
    f"""WITH {EV} SELECT u, event_id, event_type, v FROM (
        SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
        WHERE rn = 1""",
)
def latest(spark, sf):
    out = A.latest_per_key(events(spark, sf), ["u"], ["ts", "event_id"])
    return out.select("u", "event_id", "event_type", "v")


@query(
    "sort_recent",
    f"""WITH {EV} SELECT event_id, {secs_sql()} AS at, event_type, v FROM ev
        ORDER BY ts DESC, event_id LIMIT 100""",
)
def recent(spark, sf):
    columns = [F.col("event_id"), secs("ts").alias("at"), F.col("event_type"), F.col("v")]
    return A.recent(events(spark, sf), columns, ties=["event_id"])


@query(
    "union_datasets",
    """SELECT dataset, count(*) AS docs, count(v) AS with_value, count(price) AS with_price FROM (
         SELECT 'aws.codepipeline' AS dataset, value AS v, NULL AS price FROM events
           WHERE event_type = 'click'
         UNION ALL SELECT 'aws.codebuild', value, NULL FROM events WHERE event_type = 'view'
         UNION ALL SELECT 'aws.billing', NULL, o_totalprice FROM orders) GROUP BY 1""",
)
def union_datasets(spark, sf):
    df = events(spark, sf)
    one = filters.where_equal(df, event_type="click").select(
        F.lit("aws.codepipeline").alias("dataset"), "v"
    )
    two = filters.where_equal(df, event_type="view").select(
        F.lit("aws.codebuild").alias("dataset"), "v"
    )
    three = table(spark, sf, "orders").select(
        F.lit("aws.billing").alias("dataset"), F.col("o_totalprice").alias("price")
    )
    return Docs.union_indices(one, two, three).groupBy("dataset").agg(
        F.count("*").alias("docs"), F.count("v").alias("with_value"),
        F.count("price").alias("with_price"),
    )


@query(
    "union_timeline",
    f"""SELECT signal, service, bucket, count(*) AS n FROM (
        SELECT 'logs' AS signal, event_type AS service, {bucket_sql(86400)} AS bucket FROM events
        UNION ALL SELECT 'traces', o_orderpriority, {bucket_sql(86400, "o_orderdate")} FROM orders
        UNION ALL SELECT 'metrics', l_returnflag, {bucket_sql(86400, "l_shipdate")} FROM lineitem)
        GROUP BY 1, 2, 3""",
)
def union_timeline(spark, sf):
    one = events(spark, sf).select(
        "ts", F.lit("logs").alias("signal"), F.col("event_type").alias("service")
    )
    two = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("traces").alias("signal"),
        F.col("o_orderpriority").alias("service"),
    )
    three = items(spark, sf).select(
        "ts", F.lit("metrics").alias("signal"), F.col("l_returnflag").alias("service")
    )
    day = A.bucket(F.col("ts"), "1 day").alias("bucket")
    out = A.timeline(one, two, three).groupBy("signal", "service", day).agg(F.count("*").alias("n"))
    return out.withColumn("bucket", secs("bucket"))


@query(
    "metrics_rollup",
    f"""WITH {EV} SELECT event_type AS dataset, 'user=' || u AS dim, CASE WHEN k < 50 THEN 'eu-west-1'
          ELSE 'us-east-1' END AS region, 'a' || u % 3 AS account_id, {bucket_sql(86400)} AS bucket,
        {r4_sql("sum(v)")} AS sum, count(*) AS count, max(v) AS max, min(v) AS min,
        {r4_sql("avg(v)")} AS avg FROM ev GROUP BY 1, 2, 3, 4, 5""",
)
def rollup(spark, sf):
    out = metrics.rollup(metric_rows(spark, sf), "1 day", keep=["user"])
    return out.select(
        "dataset", F.concat(F.lit("user="), "dim_user").alias("dim"), "region", "account_id",
        secs("bucket").alias("bucket"), r4(F.col("sum")).alias("sum"), "count", "max", "min",
        r4(F.col("avg")).alias("avg"),
    )


def metric_rows(spark, sf):
    """Events as long metric rows: one row per user, event type, region and minute."""
    region = F.when(F.col("k") < 50, "eu-west-1").otherwise("us-east-1")
    return (
        events(spark, sf)
        .groupBy("event_type", "u", region.alias("region"), F.window("ts", "1 minute").getField("start").alias("ts"))
        .agg(
            F.avg("v").alias("avg"), F.sum("v").alias("sum"), F.count("*").alias("count"),
            F.max("v").alias("max"), F.min("v").alias("min"),
        )
        .select(
            "ts", F.col("event_type").alias("dataset"), F.lit("Duration").alias("metric"),
            F.create_map(
                F.lit("user"), F.col("u").cast("string"), F.lit("type"), F.col("event_type")
            ).alias("dimensions"),
            "region", F.concat(F.lit("a"), F.col("u") % 3).alias("account_id"),
            "avg", "sum", "count", "max", "min",
        )
    )


@query(
    "stats_sketch_percentiles",
    f"""WITH {EV} SELECT event_type, count(v) AS n, true AS p50, true AS p95, true AS p99 FROM ev GROUP BY 1""",
)
def sketch_percentiles(spark, sf):
    """Sketches per six hours, merged over all time; the rank of every estimate among the raw values
    lies within 2 % of the one asked for."""
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    df = events(spark, sf)
    stored = S.quantile_sketches(df, ["event_type"], "v", "6 hours")
    merged = S.quantiles(S.merge_quantiles(stored, ["event_type"]), ["event_type"], list(probs.values()))
    known = df.filter(F.col("v").isNotNull()).join(merged, "event_type")

    def near(name: str, p: float):
        # equal values share a range of ranks: the one asked for lies in it, or close to it
        above = F.avg((F.col("v") <= F.col(name)).cast("double")) >= p - 0.02
        below = F.avg((F.col("v") < F.col(name)).cast("double")) <= p + 0.02
        return (above & below).alias(name)

    return known.groupBy("event_type").agg(
        F.first("n").alias("n"), *[near(name, p) for name, p in probs.items()]
    )


@query(
    "stats_sketch_distinct",
    f"""WITH {EV} SELECT event_type, count(DISTINCT u) AS users, true AS close FROM ev GROUP BY 1""",
)
def sketch_distinct(spark, sf):
    """Distinct users from sketches per six hours, within 6 % of the exact number."""
    df = events(spark, sf)
    found = S.distinct_counts(S.distinct_sketches(df, ["event_type"], "u", "6 hours"), ["event_type"])
    exact = df.groupBy("event_type").agg(F.count_distinct("u").alias("users"))
    off = F.abs(F.col("distinct") - F.col("users"))
    return exact.join(found, "event_type").select("event_type", "users", (off <= 0.06 * F.col("users")).alias("close"))


@query(
    "stats_sketch_overlap",
    f"""WITH {EV}, d AS (SELECT DISTINCT event_type, u, {bucket_sql(86400)} // 86400 % 2 = 0 AS old FROM ev),
        p AS (SELECT event_type, u, bool_or(old) AS a, bool_or(NOT old) AS b FROM d GROUP BY 1, 2)
        SELECT event_type, count(*) FILTER (a) AS before, count(*) FILTER (b) AS after,
          count(*) FILTER (a AND b) AS returned, count(*) FILTER (b AND NOT a) AS appeared,
          count(*) FILTER (a AND NOT b) AS gone FROM p GROUP BY 1 HAVING before > 0 AND after > 0""",
)
def sketch_overlap(spark, sf):
    """Users of even days that came back on odd days, from daily sets; sets of up to 16,384
    values are exact."""
    daily = S.set_sketches(events(spark, sf), ["event_type"], "u", "1 day")
    even = F.unix_date(F.to_date("bucket")) % 2 == 0
    part = lambda test: S.merge_sets(daily.filter(test), ["event_type"])
    return S.compare_sets(part(even), part(~even), ["event_type"])

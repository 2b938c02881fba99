"""S*, E*, R*, F*, J1, J2, J8, U3: enrichment, routing, writing and filtering of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, secs, secs_sql, table

from skyledger.functions import scalars as X
from skyledger.operators import enrich as E
from skyledger.operators import filters, route
from skyledger.operators import stats as A
from skyledger.session import scratch_path
from skyledger.sources import documents as Docs
from skyledger.sources import registry as R
from skyledger.sources import sinks

# Event types stand for services of five kinds of delivery.
SERVICE = (
    "CASE event_type WHEN 'click' THEN 'lambda' WHEN 'view' THEN 'vpc' WHEN 'purchase' THEN 'alb' "
    "WHEN 'signup' THEN 'firehose' ELSE 'guardduty' END"
)
# Fixed expectations, written out for the comparison side.
LOGS_SQL = (
    "CASE svc WHEN 'lambda' THEN 'aws.lambda_logs' WHEN 'vpc' THEN 'aws.vpcflow' "
    "WHEN 'alb' THEN 'aws.elb_logs' WHEN 'firehose' THEN 'aws.firehose' ELSE 'aws.guardduty' END"
)
METRICS_SQL = (
    "CASE svc WHEN 'lambda' THEN 'aws.lambda' WHEN 'vpc' THEN 'aws.vpcflow' "
    "WHEN 'alb' THEN 'aws.elb' WHEN 'firehose' THEN 'aws.firehose' ELSE 'aws.guardduty' END"
)
SOURCE_SQL = (
    "CASE WHEN k < 10 THEN 'otel' WHEN k < 20 THEN 'agent' WHEN svc = 'lambda' THEN 'cloudwatch' "
    "WHEN svc IN ('vpc', 'alb') THEN 's3' WHEN svc = 'firehose' THEN 'firehose' ELSE 'api' END"
)
OVERRIDE = (
    "CASE WHEN k < 10 THEN 'otel' WHEN k < 20 THEN 'agent' WHEN k < 50 THEN 'default' ELSE '' END"
)
SV = f"{EV}, sv AS (SELECT *, {SERVICE} AS svc FROM ev), so AS (SELECT *, {SOURCE_SQL} AS src FROM sv)"


def raw_documents(spark, sf):
    """Bare documents: some carry a level, an agent-free cloud block and a service name."""
    return events(spark, sf).select(
        "event_id", "ts", "k", "event_type",
        F.expr(SERVICE).alias("service_id"),
        F.expr(OVERRIDE).alias("source_override"),
        F.struct(
            F.lit("aws").alias("provider"),
            F.when(F.col("k") >= 50, "eu-west-1").alias("region"),
            F.struct(
                F.when(F.col("k") >= 30, F.col("u").cast("string")).alias("id")
            ).alias("account"),
        ).alias("cloud"),
        F.struct(
            F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"),
            F.when(F.col("k") < 40, "aws.custom").alias("dataset"),
        ).alias("event"),
        F.struct(F.when(F.col("k") < 5, "error").alias("level")).alias("log"),
        F.struct(F.when(F.col("k") < 15, "own-name").alias("name")).alias("service"),
    )


@query(
    "enrich_fill_missing",
    f"""WITH {SV} SELECT coalesce(CASE WHEN k < 5 THEN 'error' END, 'info') AS level,
        coalesce(CASE WHEN k >= 50 THEN 'eu-west-1' END, 'us-east-1') AS region, count(*) AS n
        FROM sv GROUP BY 1, 2""",
)
def fill_missing(spark, sf):
    out = E.fill_missing(
        raw_documents(spark, sf), {"log.level": F.lit("info"), "cloud.region": F.lit("us-east-1")}
    )
    return out.groupBy(
        F.col("log.level").alias("level"), F.col("cloud.region").alias("region")
    ).agg(F.count("*").alias("n"))


@query(
    "enrich_logs",
    f"""WITH {SV} SELECT event_id, src AS source, {LOGS_SQL} AS dataset, 'logs' AS kind,
        CASE WHEN k < 40 THEN 'aws.custom' ELSE {LOGS_SQL} END AS event_dataset, 'aws' AS module,
        CASE src WHEN 's3' THEN 'aws-s3' WHEN 'cloudwatch' THEN 'aws-cloudwatch'
          WHEN 'firehose' THEN 'aws-firehose' WHEN 'api' THEN 'http_endpoint'
          WHEN 'otel' THEN 'opentelemetry' ELSE 'logfile' END AS input,
        CASE WHEN k IN (60, 61) THEN 'own'
          WHEN src = 'agent' THEN 'elastic-agent' WHEN src = 'otel' THEN 'otel' ELSE 'filebeat' END AS agent,
        CASE WHEN k IN (60, 61) THEN NULL ELSE CASE src WHEN 'agent' THEN 'elastic-agent-'
          WHEN 'otel' THEN 'otel-collector-' ELSE 'filebeat-aws-' END
          || CASE WHEN k >= 50 THEN 'eu-west-1' ELSE 'us-east-1' END END AS agent_name,
        CASE WHEN k IN (60, 61) THEN NULL WHEN src = 'otel' THEN '0.115.0' ELSE '8.18.0' END AS agent_version,
        CASE WHEN k IN (60, 61) THEN 'here' END AS agent_site,
        CASE WHEN k >= 20 THEN 'app' END AS logger, '10.0.0.' || k AS host_ip, 'v' || k AS service_version,
        CASE WHEN k BETWEEN 70 AND 74 THEN 'aws.s3_storage_lens' ELSE {LOGS_SQL} END AS stream,
        'aws-' || svc || '-logs-' || CASE WHEN k >= 30 THEN CAST(u AS VARCHAR) ELSE '814726593401' END
          AS bucket,
        CASE WHEN k < 25 THEN '/mine' ELSE '/aws/' || svc || '/logs' END AS log_group,
        strftime(ts, '%Y/%m/%d') AS day,
        src = 'firehose' AS firehose, svc = 'lambda' AS host,
        CASE WHEN k < 15 THEN 'own-name' ELSE svc END AS service_name,
        CASE WHEN k < 15 THEN NULL ELSE 'aws' END AS service_type,
        CASE WHEN k < 5 THEN 'error' ELSE 'info' END AS level,
        src = 'otel' AS telemetry, '8.11.0' AS schema_version FROM so""",
)
def enrich_logs(spark, sf):
    k = F.col("k").cast("string")
    docs = raw_documents(spark, sf).withColumns(
        {
            "log": F.struct("log.level", F.when(F.col("k") >= 20, "app").alias("logger")),
            "service": F.struct("service.name", F.concat(F.lit("v"), k).alias("version")),
            "host": F.struct(F.concat(F.lit("10.0.0."), k).alias("ip")),
            "agent": F.when(
                F.col("k").isin(60, 61), F.struct(F.lit("own").alias("type"), F.lit("here").alias("site"))
            ),
            "aws": F.parse_json(
                F.when(F.col("k") < 25, F.lit('{"cloudwatch":{"log_group":"/mine"}}')).otherwise(F.lit("{}"))
            ),
            "__dataset": F.when(F.col("k").between(70, 74), F.lit("aws.s3_storage_lens")),
        }
    )
    out = E.enrich(docs, "logs", "event_id", override="source_override")
    out = route.stream_of(out, "logs")
    key = F.split(F.col("aws_context.s3.object.key"), "/")
    return out.select(
        "event_id", F.col("ingest_source").alias("source"),
        F.col("data_stream.dataset").alias("dataset"), F.col("data_stream.type").alias("kind"),
        F.col("event.dataset").alias("event_dataset"), F.col("event.module").alias("module"),
        F.col("input.type").alias("input"), F.col("agent.type").alias("agent"),
        F.col("agent.name").alias("agent_name"), F.col("agent.version").alias("agent_version"),
        F.col("agent.site").alias("agent_site"), F.col("log.logger").alias("logger"),
        F.col("host.ip").alias("host_ip"), F.col("service.version").alias("service_version"),
        F.col("stream_dataset").alias("stream"),
        F.col("aws_context.s3.bucket.name").alias("bucket"),
        F.col("aws_context.cloudwatch.log_group").alias("log_group"),
        F.concat_ws("/", F.slice(key, 5, 3)).alias("day"),
        F.col("aws_context.firehose").isNotNull().alias("firehose"),
        F.col("host.name").isNotNull().alias("host"),
        F.col("service.name").alias("service_name"), F.col("service.type").alias("service_type"),
        F.col("log.level").alias("level"), F.col("telemetry").isNotNull().alias("telemetry"),
        F.col("ecs.version").alias("schema_version"),
    )


@query(
    "enrich_metrics",
    f"""WITH {SV} SELECT {METRICS_SQL} AS dataset, 'metricbeat-aws-' ||
        CASE WHEN k >= 50 THEN 'eu-west-1' ELSE 'us-east-1' END AS agent_name, count(*) AS n
        FROM sv GROUP BY 1, 2""",
)
def enrich_metrics(spark, sf):
    out = E.enrich(raw_documents(spark, sf), "metrics", "event_id")
    return out.groupBy(
        F.col("data_stream.dataset").alias("dataset"), F.col("agent.name").alias("agent_name")
    ).agg(F.count("*").alias("n"))


@query(
    "enrich_traces",
    f"""WITH {SV} SELECT {LOGS_SQL} AS dataset, 'opentelemetry' AS input, count(*) AS n
        FROM sv GROUP BY 1""",
)
def enrich_traces(spark, sf):
    out = E.enrich(raw_documents(spark, sf), "traces", "event_id")
    return out.filter(F.col("agent").isNull()).groupBy(
        F.col("data_stream.dataset").alias("dataset"), F.col("input.type").alias("input")
    ).agg(F.count("*").alias("n"))


@query(
    "join_service_registry",
    f"""WITH {SV} SELECT svc AS service, {LOGS_SQL} AS logs_dataset, {METRICS_SQL} AS metrics_dataset,
        count(*) AS n FROM sv GROUP BY 1, 2, 3""",
)
def service_registry(spark, sf):
    docs = raw_documents(spark, sf).withColumnRenamed("service", "service_body").withColumnRenamed(
        "service_id", "service"
    )
    reg = R.registry(docs.select("service").distinct())
    return R.join_registry(docs, reg).groupBy("service", "logs_dataset", "metrics_dataset").agg(
        F.count("*").alias("n")
    )


@query(
    "filter_metrics_capable",
    f"""WITH {EV} SELECT svc AS service, count(*) AS n FROM (SELECT CASE event_type
        WHEN 'click' THEN 'lambda' WHEN 'view' THEN 'kendra' WHEN 'purchase' THEN 'sqs'
        WHEN 'signup' THEN 'wickr' ELSE 'ec2' END AS svc FROM ev)
        WHERE svc NOT IN ('kendra', 'wickr') GROUP BY 1""",
)
def metrics_capable(spark, sf):
    svc = F.expr(
        "CASE event_type WHEN 'click' THEN 'lambda' WHEN 'view' THEN 'kendra' "
        "WHEN 'purchase' THEN 'sqs' WHEN 'signup' THEN 'wickr' ELSE 'ec2' END"
    )
    docs = events(spark, sf).select(svc.alias("service"))
    reg = R.registry(docs.distinct())
    return R.metrics_capable(docs, reg).groupBy("service").agg(F.count("*").alias("n"))


ROUTE_OVERRIDE = (
    "CASE WHEN k < 10 THEN 'aws.s3_storage_lens' WHEN k < 20 THEN 'cloud_security_posture.findings' "
    "WHEN k < 30 THEN '' END"
)


@query(
    "route_documents",
    f"""WITH {SV}, r AS (SELECT *, {LOGS_SQL} AS ds, {ROUTE_OVERRIDE} AS ov FROM sv)
        SELECT CASE WHEN k < 10 THEN 'logs-aws.s3_storage_lens-default'
            WHEN k < 20 THEN 'logs-cloud_security_posture.findings-default'
            ELSE 'logs-' || ds || '-default' END AS index, count(*) AS n FROM r GROUP BY 1""",
)
def route_documents(spark, sf):
    svc = F.col("service_id")
    docs = raw_documents(spark, sf).withColumn("__dataset", F.expr(ROUTE_OVERRIDE))
    prefix = F.lit("logs-aws")
    index = route.route_override(
        F.col("__dataset"), prefix, route.index_name(prefix, R.resolve_dataset(svc, "logs"))
    )
    return docs.groupBy(index.alias("index")).agg(F.count("*").alias("n"))


@query(
    "route_trace_prefix",
    f"""WITH {EV} SELECT CASE WHEN event_type = 'error' THEN 'traces-aws.xray-default'
        ELSE 'metrics-aws.' || event_type || '-default' END AS index, count(*) AS n FROM ev GROUP BY 1""",
)
def trace_prefix(spark, sf):
    ds = F.when(F.col("event_type") == "error", "aws.xray").otherwise(
        F.concat(F.lit("aws."), "event_type")
    )
    index = route.index_name(F.lit("metrics-aws"), ds).alias("index")
    return events(spark, sf).groupBy(index).agg(F.count("*").alias("n"))


@query(
    "route_by_log_group",
    f"""WITH {EV} SELECT CASE event_type WHEN 'click' THEN 'logs-aws.glue'
        WHEN 'view' THEN 'logs-aws.sagemaker' ELSE 'logs-aws.cloudwatch' END AS index, count(*) AS n
        FROM ev GROUP BY 1""",
)
def by_log_group(spark, sf):
    """S12 and R4 over raw subscription rows."""
    group = F.expr(
        "CASE event_type WHEN 'click' THEN '/aws-glue/jobs/output' "
        "WHEN 'view' THEN '/aws/SageMaker/Endpoints' ELSE concat('/aws/lambda/', u) END"
    )
    raw = events(spark, sf).select(group.alias("log_group"), "ts", F.col("props").alias("message"))
    return raw.groupBy(route.route_by_log_group(F.col("log_group")).alias("index")).agg(
        F.count("*").alias("n")
    )


@query(
    "route_subservices",
    f"""WITH {EV} SELECT CASE WHEN k < 30 THEN 'aws.rdsproxy' WHEN k < 60 THEN 'aws.rdscustom'
        ELSE 'aws.rds' END AS dataset, count(*) AS n FROM ev GROUP BY 1""",
)
def subservices(spark, sf):
    sub = F.expr("CASE WHEN k < 30 THEN 'aws.rdsproxy' WHEN k < 60 THEN 'aws.rdscustom' END")
    docs = events(spark, sf).withColumn("__dataset", sub)
    return route.fold_subservices(docs, F.lit("aws.rds")).groupBy("dataset").agg(
        F.count("*").alias("n")
    )


def _streamed(spark, sf):
    docs = raw_documents(spark, sf).withColumn("__dataset", F.expr(ROUTE_OVERRIDE))
    return route.stream_of(docs, "logs")


@query(
    "sink_data_streams",
    f"""WITH {SV} SELECT type, dataset, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM (
        SELECT k, 'logs' AS type, CASE WHEN k < 10 THEN 'aws.s3_storage_lens'
          WHEN k < 20 THEN 'cloud_security_posture.findings' ELSE {LOGS_SQL} END AS dataset FROM sv)
        WHERE dataset LIKE 'aws.%l%' GROUP BY 1, 2""",
)
def data_streams(spark, sf):
    """Write per stream, then read back through an index pattern."""
    root = scratch_path(spark, "streams")
    sinks.write_data_stream(_streamed(spark, sf), root, max_records=sinks.BATCH_DOCS * 100)
    out = Docs.scan_index(spark, root, "logs-aws.*l*")
    return out.groupBy("type", "dataset").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


@query(
    "scan_prefix_pattern",
    f"""WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('purchase', 'signup')
        GROUP BY 1""",
)
def prefix_pattern(spark, sf):
    """S3: several prefix patterns over type, dataset and namespace columns."""
    docs = events(spark, sf).select(
        "event_type", F.lit("logs").alias("type"),
        F.concat(F.lit("aws."), "event_type").alias("dataset"),
        F.lit("default").alias("namespace"),
    )
    wanted = Docs.index_pattern("logs-aws.pur*,logs-aws.signup-default")
    return docs.filter(wanted).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "sink_bulk_lines",
    f"""WITH {EV} SELECT 'logs-aws.' || event_type || '-default' AS index, count(*) AS actions,
        CAST(sum(u) AS BIGINT) AS sum_u FROM ev GROUP BY 1""",
)
def bulk_lines(spark, sf):
    """Action and document lines, written as text and read back line by line."""
    docs = events(spark, sf).select(
        "event_id", "u", F.concat(F.lit("aws."), "event_type").alias("dataset")
    )
    path = scratch_path(spark, "bulk")
    index = route.index_name(F.lit("logs-aws"), F.col("dataset"))
    sinks.write_bulk_ndjson(docs, index, path, batch=sinks.BATCH_DOCS * 40, exclude=("dataset",))
    line = F.try_parse_json("value")
    back = spark.read.text(path).select(
        F.try_variant_get(line, "$.create._index", "string").alias("index"),
        F.try_variant_get(line, "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get(line, "$.u", "bigint").alias("u"),
    )
    kinds = events(spark, sf).select(
        "event_id", F.concat(F.lit("logs-aws."), "event_type", F.lit("-default")).alias("home")
    )
    sums = back.join(kinds, "event_id").groupBy(F.col("home").alias("index")).agg(
        F.sum("u").alias("sum_u")
    )
    actions = back.filter("index IS NOT NULL").groupBy("index").agg(F.count("*").alias("actions"))
    return actions.join(sums, "index")


@query(
    "sink_append_create_only",
    f"""WITH {EV}, ex AS (SELECT DISTINCT u, event_type FROM ev WHERE k < 20)
        SELECT u, event_type, min(event_id) AS event_id FROM ev
        WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.u = ev.u AND ex.event_type = ev.event_type)
        GROUP BY 1, 2""",
)
def append_create_only(spark, sf):
    """Keys that already exist are skipped; a repeated key keeps its first row."""
    df = events(spark, sf)
    out = sinks.append_create_only(
        df, df.filter(F.col("k") < 20), ["u", "event_type"], ["event_id"]
    )
    return out.select("u", "event_type", "event_id")


@query(
    "sink_create_only_table",
    f"""WITH {EV}, h AS (SELECT *, {bucket_sql(3600)} AS hour FROM ev),
        a AS (SELECT u, event_type, hour, min(event_id) AS event_id FROM h WHERE event_id % 2 = 0 GROUP BY 1, 2, 3),
        b AS (SELECT u, event_type, hour, min(event_id) AS event_id FROM h GROUP BY 1, 2, 3)
        SELECT b.u, b.event_type, b.hour, coalesce(a.event_id, b.event_id) AS event_id
        FROM b LEFT JOIN a ON a.u = b.u AND a.event_type = b.event_type AND a.hour = b.hour""",
)
def create_only_table(spark, sf):
    """Two appends to a stored table that is never shuffled."""
    hour = F.date_trunc("hour", F.col("ts"))
    df = events(spark, sf).select("u", "event_type", hour.alias("ts"), "event_id")
    path = scratch_path(spark, "create-only")
    stored = sinks.CreateOnlyTable(
        "create_only_" + path.rsplit("-", 1)[1], ["u", "event_type", "ts"], buckets=8, path=path
    )
    stored.append(df.filter("event_id % 2 = 0"), ["event_id"])
    stored.append(df, ["event_id"])
    return stored.read(spark).select("u", "event_type", secs("ts").alias("hour"), "event_id")


FAILED = "CASE WHEN k < 10 THEN 'version_conflict_engine_exception' WHEN k < 15 THEN 'mapper_parsing_exception' WHEN k < 18 THEN 'timeout' END"


@query(
    "sink_ingest_outcomes",
    f"""WITH {EV} SELECT event_type AS dataset, count(*) FILTER (k >= 18) AS indexed,
        count(*) FILTER (k < 10) AS conflict, count(*) FILTER (k >= 10 AND k < 18) AS failed,
        min_by({FAILED}, event_id) FILTER (k >= 10 AND k < 18) AS first_error_type,
        min_by('bad ' || k, event_id) FILTER (k >= 10 AND k < 18) AS first_error_reason
        FROM ev GROUP BY 1""",
)
def ingest_outcomes(spark, sf):
    df = events(spark, sf).select(
        F.col("event_type").alias("dataset"), F.col("event_id").alias("seq"),
        F.expr(FAILED).alias("error_type"),
        F.when(F.col("k") < 18, F.concat(F.lit("bad "), F.col("k"))).alias("error_reason"),
    )
    return sinks.ingest_outcomes(df)


@query(
    "sink_quarantine",
    f"""WITH {EV} SELECT CASE WHEN k < 5 THEN 'key_too_small' WHEN v > 200 THEN 'value_too_large'
        ELSE 'good' END AS verdict, count(*) AS n FROM ev GROUP BY 1""",
)
def quarantine(spark, sf):
    rules = [
        sinks.Rule("key_too_small", F.col("k") >= 5),
        sinks.Rule("value_too_large", F.col("v") <= 200),
    ]
    good, bad = sinks.quarantine(events(spark, sf), rules)
    verdicts = good.select(F.lit("good").alias("verdict")).unionByName(
        bad.select(F.col("error_type").alias("verdict"))
    )
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "preview_newest",
    f"""WITH {EV} SELECT {secs_sql()} AS at, '{{"event_id":' || event_id || ',"u":' || u || '}}' AS doc
        FROM ev ORDER BY ts DESC LIMIT 10""",
)
def preview(spark, sf):
    out = Docs.preview(events(spark, sf).select("event_id", "u", "ts"), 10)
    doc = F.regexp_replace("doc", ',"ts":"[^"]*"', "")
    return out.select(secs("ts").alias("at"), doc.alias("doc"))


@query(
    "filter_equal",
    f"""WITH {EV} SELECT event_type, k, count(*) AS n FROM ev WHERE event_type = 'error'
        GROUP BY 1, 2""",
)
def filter_equal(spark, sf):
    out = filters.where_equal(events(spark, sf), event_type="error")
    return out.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(
    "filter_time_range",
    """SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'""",
)
def filter_time_range(spark, sf):
    """The raw column is compared with its own type, so the range reaches the scan."""
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    out = filters.time_range(
        table(spark, sf, "events"), day("2024-01-10 06:00:00"), day("2024-01-20 18:00:00")
    )
    return out.agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query(
    "filter_score",
    f"WITH {EV} SELECT event_id, v AS score FROM ev WHERE v >= 50",
)
def filter_score(spark, sf):
    df = events(spark, sf).select("event_id", F.col("v").alias("score"))
    return filters.min_score(df)


@query(
    "filter_valid_prefix",
    """SELECT count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM (
        SELECT regexp_matches(trim(p), '^[a-zA-Z0-9_-]{1,80}$')
          AND left(trim(p), 1) NOT IN ('-', '_') AND right(trim(p), 1) NOT IN ('-', '_') AS valid
        FROM (SELECT c_name AS p FROM customer UNION ALL SELECT o_orderpriority FROM orders
          UNION ALL SELECT event_type || '-' FROM events UNION ALL SELECT p_brand FROM part
          UNION ALL SELECT n_name FROM nation))""",
)
def valid_prefix(spark, sf):
    names = (
        table(spark, sf, "customer").select(F.col("c_name").alias("p"))
        .unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p")))
        .unionByName(
            table(spark, sf, "events").select(F.concat("event_type", F.lit("-")).alias("p"))
        )
        .unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("p")))
        .unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("p")))
    )
    ok = filters.valid_prefix(F.col("p"))
    return names.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(
    "sort_distinct_groups",
    "SELECT DISTINCT o_orderpriority AS grp FROM orders ORDER BY 1",
)
def distinct_groups(spark, sf):
    """Distinct group names in a stable order."""
    groups = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"))
    return groups.distinct().orderBy("grp")


@query(
    "join_id_coverage",
    """SELECT id, 'missing' AS status FROM (SELECT o_orderkey AS id FROM orders
         EXCEPT SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT id, 'unexpected' FROM (SELECT l_orderkey AS id FROM lineitem
         EXCEPT SELECT o_orderkey FROM orders)""",
)
def id_coverage(spark, sf):
    want = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    have = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return A.id_coverage(want, have, "id")


@query(
    "join_part_coverage",
    """SELECT id, 'missing' AS status FROM (SELECT event_id AS id FROM events
         EXCEPT SELECT l_partkey FROM lineitem)
       UNION ALL SELECT id, 'unexpected' FROM (SELECT l_partkey AS id FROM lineitem
         EXCEPT SELECT event_id FROM events)""",
)
def part_coverage(spark, sf):
    want = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    have = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return A.id_coverage(want, have, "id")


@query(
    "union_set_operations",
    """SELECT 'both' AS side, id FROM (SELECT c_custkey AS id FROM customer INTERSECT
         SELECT o_custkey FROM orders)
       UNION ALL SELECT 'only_customers', id FROM (SELECT c_custkey AS id FROM customer EXCEPT
         SELECT o_custkey FROM orders)""",
)
def set_operations(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    both = want.intersect(have).select(F.lit("both").alias("side"), "id")
    return both.unionByName(want.subtract(have).select(F.lit("only_customers").alias("side"), "id"))


@query(
    "scan_bucketed_days",
    f"WITH {EV} SELECT {bucket_sql(86400)} AS day, count(*) AS n FROM ev GROUP BY 1",
)
def bucketed_days(spark, sf):
    """Documents written as JSON lines and read back as one VARIANT column."""
    path = scratch_path(spark, "documents")
    events(spark, sf).select(F.to_json(F.struct("event_id", secs("ts").alias("at"))).alias("value")) \
        .write.text(path)
    docs = Docs.read_documents(spark, path, multi_line=False)
    at = F.try_variant_get("doc", "$.at", "bigint")
    day = (F.floor(at / 86400) * 86400).cast("bigint").alias("day")
    return docs.groupBy(day).agg(F.count("*").alias("n"))


@query(
    "scan_log_documents",
    f"""WITH {EV} SELECT event_type AS dataset, 'logs' AS type, count(*) AS n,
        CAST(sum(k) AS BIGINT) AS sum_k, count(*) FILTER (event_type = 'view') AS listed FROM ev
        GROUP BY 1""",
)
def log_documents(spark, sf):
    """Typed read of log documents with a VARIANT tail and drifting category."""
    path = scratch_path(spark, "logs")
    text = F.expr(
        """concat('{"@timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
           '","event":{"category":', CASE WHEN event_type = 'view' THEN '["web","api"]'
           ELSE '"web"' END, ',"outcome":"success"},"data_stream":{"type":"logs","dataset":"',
           event_type, '","namespace":"default"},"aws":{"svc":{"a.b":', k, '}}}')"""
    )
    events(spark, sf).select(text.alias("value")).write.text(path)
    df = Docs.read_logs(spark, path)
    tail = F.try_variant_get("aws", "$['svc']['a.b']", "bigint")
    return df.groupBy(
        F.col("data_stream.dataset").alias("dataset"), F.col("data_stream.type").alias("type")
    ).agg(
        F.count("ts").alias("n"), F.sum(tail).alias("sum_k"),
        F.count_if(F.size("event.category") == 2).alias("listed"),
    )


@query(
    "scan_metric_documents",
    f"""WITH {EV} SELECT 'aws.' || event_type AS dataset, CASE WHEN k < 50 THEN 'eu-west-1' ELSE 'us-east-1'
          END AS region, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, max({secs_sql()}) AS newest
        FROM ev GROUP BY 1, 2""",
)
def metric_documents(spark, sf):
    """Metric documents written as JSON lines, read as long rows."""
    path = scratch_path(spark, "metric-docs")
    stat = F.struct(F.col("k").alias("avg"), F.col("k").alias("sum"), F.lit(1).alias("count"))
    body = F.struct(F.struct(F.struct(stat.alias("a.b")).alias("metrics")).alias("svc"))
    region = F.when(F.col("k") < 50, "eu-west-1").otherwise("us-east-1")
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(F.concat(F.lit("aws."), "event_type").alias("dataset")).alias("data_stream"),
        F.struct(region.alias("region"), F.struct(F.lit("1").alias("id")).alias("account")).alias("cloud"),
        body.alias("aws"),
    )
    events(spark, sf).select(F.to_json(doc).alias("value")).write.text(path)
    return Docs.read_metrics(spark, path).groupBy("dataset", "region").agg(
        F.count("*").alias("n"), F.sum("sum").cast("bigint").alias("sum_k"), F.max(secs("ts")).alias("newest")
    )


def _trace_lines(spark, sf, label: str) -> str:
    """Events as trace documents, one JSON line each: transactions, spans and errors."""
    path = scratch_path(spark, label)
    kind = F.when(F.col("k") < 20, "transaction").when(F.col("k") < 70, "span").otherwise("error")
    own = F.struct(
        F.concat(F.lit("i"), "event_id").alias("id"), F.struct(F.col("u").alias("us")).alias("duration"),
        F.col("event_type").alias("name"),
    )
    caught = F.array(F.struct(F.lit("E").alias("type"), F.lit(True).alias("handled")))
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(kind.alias("event")).alias("processor"),
        F.struct(F.concat(F.lit("t"), "u").alias("id")).alias("trace"),
        F.when(kind == "transaction", own).alias("transaction"),
        F.when(kind == "span", own).alias("span"),
        F.when(kind == "error", F.struct(F.col("event_type").alias("culprit"), caught.alias("exception"))).alias(
            "error"
        ),
    )
    events(spark, sf).select(F.to_json(doc).alias("value")).write.text(path)
    return path


@query(
    "scan_span_documents",
    f"""WITH {EV} SELECT CASE WHEN k < 20 THEN 'transaction' ELSE 'span' END AS kind, event_type AS name,
        count(*) AS n, CAST(sum(u) AS BIGINT) AS us, count(DISTINCT u) AS traces FROM ev WHERE k < 70
        GROUP BY 1, 2""",
)
def span_documents(spark, sf):
    """Transactions and spans written as JSON lines, read into the span layout."""
    df = Docs.read_spans(spark, _trace_lines(spark, sf, "span-docs"))
    return df.groupBy("kind", "name").agg(
        F.count("id").alias("n"), F.sum("duration_us").alias("us"), F.count_distinct("trace_id").alias("traces")
    )


@query(
    "scan_error_documents",
    f"""WITH {EV} SELECT event_type AS culprit, 'E' AS kind, count(*) AS n, max({secs_sql()}) AS newest FROM ev
        WHERE k >= 70 GROUP BY 1""",
)
def error_documents(spark, sf):
    """Error documents written as JSON lines."""
    df = Docs.read_errors(spark, _trace_lines(spark, sf, "error-docs"))
    kind = F.get("exception", F.lit(0)).getField("type")
    return df.groupBy("culprit", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.max(secs("ts")).alias("newest")
    )


@query(
    "scalar_round_places",
    """SELECT event_type, CAST(sum(round(CAST(value AS DECIMAL(18, 4)), 2)) AS DOUBLE) AS total FROM events
       GROUP BY 1""",
)
def rounded(spark, sf):
    """Halves are rounded away from zero."""
    x = X.round_places(F.col("v").cast("decimal(18,4)"), 2)
    return events(spark, sf).groupBy("event_type").agg(F.sum(x).cast("double").alias("total"))

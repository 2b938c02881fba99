"""P*, X*: message parsing and scalar functions over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql, table
from skyledger.functions import scalars as X
from skyledger.operators import invocations, parse, security

from skyledger.operators.enrich import normalise_category, strip_nulls
from skyledger.operators.enrich import strip_variant_nulls as strip_variant_nulls_of
from skyledger.plans import parsers

# One log line per event. Sign-ups end a request, views start one, purchases report it, errors
# are plain application lines and clicks are JSON lines.
LINE = r"""CASE event_type
  WHEN 'view' THEN concat('START RequestId: r-', CAST(u AS {s}), ' Version: $LATEST')
  WHEN 'signup' THEN concat('END RequestId: r-', CAST(u AS {s}))
  WHEN 'purchase' THEN concat('REPORT RequestId: r-', CAST(u AS {s}), {tab}, 'Duration: ',
    CAST(k AS {s}), '.25 ms', {tab}, 'Billed Duration: ', CAST(k * 100 AS {s}), ' ms', {tab},
    'Memory Size: 512 MB', {tab}, 'Max Memory Used: ', CAST(k + 28 AS {s}), ' MB',
    CASE WHEN k < 10 THEN concat({tab}, 'Init Duration: ', CAST(k AS {s}), '.50 ms') ELSE '' END)
  WHEN 'error' THEN concat('[ERROR]', {tab}, 'r-', CAST(u AS {s}), {tab}, 'failed with ',
    CAST(k AS {s}))
  ELSE concat('{{"requestId":"r-', CAST(u AS {s}), '","level":"INFO","duration_ms":',
    CAST(k AS {s}), '}}') END"""
LINE_SPARK = LINE.format(s="STRING", tab="'\\t'")
LINE_SQL = LINE.format(s="VARCHAR", tab="chr(9)")
LINES = f"{EV}, lines AS (SELECT *, {LINE_SQL} AS message FROM ev)"


def lines(spark, sf):
    return events(spark, sf).withColumn("message", F.expr(LINE_SPARK)).withColumn(
        "dataset", F.lit("aws.lambda_logs")
    )


@query(
    "parse_json_field",
    f"WITH {EV} SELECT k, count(*) AS n, {r4_sql('avg(v)')} AS avg_v FROM ev GROUP BY 1",
)
def json_field(spark, sf):
    df = table(spark, sf, "events").withColumn("parsed", parse.json_value(F.col("props")))
    key = F.try_variant_get("parsed", "$.k", "int").alias("k")
    return df.groupBy(key).agg(F.count("*").alias("n"), r4(F.avg("value")).alias("avg_v"))


@query(
    "parse_rename_keep_target",
    f"""WITH {EV} SELECT target, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error'
        ELSE CAST(k AS VARCHAR) END AS target FROM ev) GROUP BY 1""",
)
def rename_keep(spark, sf):
    return renamed(spark, sf, "keep_target")


@query(
    "parse_rename_overwrite",
    f"WITH {EV} SELECT CAST(k AS VARCHAR) AS target, count(*) AS n FROM ev GROUP BY 1",
)
def rename_overwrite(spark, sf):
    return renamed(spark, sf, "overwrite")


def renamed(spark, sf, mode):
    parsed = parse.json_value(F.col("props"))
    preset = F.when(F.col("event_type") == "error", "error")
    target = parse.rename_into(preset, F.try_variant_get(parsed, "$.k", "string"), mode)
    return table(spark, sf, "events").groupBy(target.alias("target")).agg(F.count("*").alias("n"))


@query(
    "parse_lowercase",
    "SELECT lower(o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY 1",
)
def lowercase(spark, sf):
    level = parse.lowercase(F.col("o_orderpriority")).alias("level")
    return table(spark, sf, "orders").groupBy(level).agg(F.count("*").alias("n"))


@query(
    "parse_function_lines",
    f"""WITH {LINES} SELECT event_id,
        CASE event_type WHEN 'purchase' THEN 'r-' || u WHEN 'view' THEN 'r-' || u
          WHEN 'signup' THEN '' END AS request_id,
        CASE WHEN event_type = 'purchase' THEN k + CAST(0.25 AS DOUBLE) END AS duration_ms,
        CASE WHEN event_type = 'purchase' THEN CAST(k * 100 AS DOUBLE) END AS billed_ms,
        CASE WHEN event_type = 'purchase' THEN CAST(k + 28 AS BIGINT) END AS used_mb,
        event_type = 'click' AS parsed,
        CASE WHEN event_type = 'purchase' AND k < 10 THEN k + CAST(0.5 AS DOUBLE) END AS init_ms
        FROM lines""",
)
def function_lines(spark, sf):
    """START, END and REPORT patterns, then JSON; a trailing lazy slot takes the empty text."""
    out = parse.parse_documents(lines(spark, sf), parsers.parsers_of(["serverless"]))
    return out.select(
        "event_id", F.col("lambda__requestId").alias("request_id"),
        F.col("lambda__durationMs").alias("duration_ms"),
        F.col("lambda__billedDurationMs").alias("billed_ms"),
        F.col("lambda__maxMemoryUsedMB").alias("used_mb"),
        F.col("parsed").isNotNull().alias("parsed"),
        parse.init_duration(F.col("message")).alias("init_ms"),
    )


@query(
    "parse_app_lines",
    f"""WITH {EV} SELECT event_id, 'error' AS level, 'r-' || u AS request_id,
        'failed with ' || k AS text FROM ev WHERE event_type = 'error'""",
)
def app_lines(spark, sf):
    out = lines(spark, sf).withColumn("line", parse.function_app_line(F.col("message")))
    return out.filter("line IS NOT NULL").select("event_id", "line.*")


@query(
    "parse_by_dataset",
    f"""WITH {EV} SELECT dataset, space, target, count(*) AS n, count(job) AS with_job FROM (
        SELECT 'aws.' || event_type AS dataset, CASE event_type WHEN 'glue' THEN '' END AS space,
          NULL AS target, NULL AS job FROM ev WHERE false
        UNION ALL SELECT CASE event_type WHEN 'click' THEN 'aws.glue' WHEN 'view' THEN 'aws.emr_logs'
            WHEN 'purchase' THEN 'aws.rds' WHEN 'signup' THEN 'aws.kms' ELSE 'other' END,
          CASE event_type WHEN 'click' THEN 'glue.parsed' WHEN 'view' THEN 'emr.parsed'
            WHEN 'purchase' THEN 'rds.parsed' WHEN 'signup' THEN 'kms.parsed' END,
          CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'warn'
            WHEN 'purchase' THEN 'warn' ELSE 'INFO' END,
          CASE event_type WHEN 'click' THEN 'job-' || k END FROM ev) GROUP BY 1, 2, 3""",
)
def by_dataset(spark, sf):
    """All 187 parsers in one projection; levels that are set win over parsed ones."""
    ds = (
        "CASE event_type WHEN 'click' THEN 'aws.glue' WHEN 'view' THEN 'aws.emr_logs' "
        "WHEN 'purchase' THEN 'aws.rds' WHEN 'signup' THEN 'aws.kms' ELSE 'other' END"
    )
    message = (
        """concat('{"jobName":"job-', k, '","level":"WARN","logLevel":"Warn","thread":"t"}')"""
    )
    preset = "CASE WHEN event_type IN ('click', 'signup', 'error') THEN 'INFO' END"
    docs = events(spark, sf).withColumns(
        {"dataset": F.expr(ds), "message": F.expr(message), "level": F.expr(preset)}
    )
    out = parse.parse_documents(docs, parsers.all_parsers(), existing={"log.level": "level"})
    return out.groupBy(
        "dataset", F.col("parsed_as").alias("space"), F.col("log__level").alias("target")
    ).agg(F.count("*").alias("n"), F.count("glue__jobName").alias("with_job"))


@query(
    "parse_plain_text_kept",
    """SELECT lang, count(*) AS docs, count(*) FILTER (json_valid(text)) AS parsed, CAST(sum(strlen(text)) AS BIGINT)
       AS bytes FROM documents GROUP BY 1""",
)
def plain_text(spark, sf):
    df = table(spark, sf, "documents").withColumn("dataset", F.lit("aws.glue"))
    out = parse.parse_documents(df, parsers.parsers_of(["analytics"]), message="text")
    return out.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count("parsed").alias("parsed"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )


FLOW = """concat('2 ', CAST(100000000000 + l_suppkey AS {s}), ' eni-', CAST(l_suppkey AS {s}),
  ' 10.0.0.', CAST(l_suppkey AS {s}), ' 172.16.0.', CAST(l_partkey AS {s}), ' ',
  CAST(1024 + l_linenumber AS {s}), ' ', CAST(20 + l_linenumber AS {s}),
  CASE l_returnflag WHEN 'A' THEN ' 6 ' WHEN 'N' THEN ' 17 ' ELSE ' 1 ' END,
  CAST(CAST(l_quantity AS INT) AS {s}), ' ', CAST(CAST(l_quantity AS INT) * 1500 AS {s}), ' ',
  CAST({at} AS {s}), ' ', CAST({at} + 60 AS {s}),
  CASE l_linestatus WHEN 'O' THEN ' ACCEPT OK' ELSE ' REJECT OK' END)"""


def flows(spark, sf):
    """Line items as version 2 flow records, parsed back into columns."""
    line = FLOW.format(s="STRING", at="unix_seconds(CAST(l_shipdate AS TIMESTAMP))")
    df = table(spark, sf, "lineitem").withColumn("message", F.expr(line))
    return df.select("message", parse.flow_record(F.col("message")).alias("f")).select(
        "message", "f.*"
    )


@query(
    "parse_flow_records",
    f"""SELECT srcaddr, protocol_name, outcome, level, count(*) AS flows,
        CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
        min(start) AS first_start, CAST(max(dstport) AS INT) AS max_port FROM (
        SELECT '10.0.0.' || l_suppkey AS srcaddr, CASE l_returnflag WHEN 'A' THEN 'tcp'
          WHEN 'N' THEN 'udp' ELSE 'icmp' END AS protocol_name,
          CASE l_linestatus WHEN 'O' THEN 'success' ELSE 'failure' END AS outcome,
          CASE l_linestatus WHEN 'O' THEN 'info' ELSE 'warn' END AS level,
          CAST(l_quantity AS INT) AS packets, CAST(l_quantity AS INT) * 1500 AS bytes,
          {secs_sql("l_shipdate")} AS start, 20 + l_linenumber AS dstport FROM lineitem)
        GROUP BY 1, 2, 3, 4""",
)
def flow_records(spark, sf):
    action = F.col("action")
    return (
        flows(spark, sf)
        .groupBy(
            "srcaddr", X.protocol_name(F.col("protocol")).alias("protocol_name"),
            X.flow_outcome(action).alias("outcome"), X.flow_level(action).alias("level"),
        )
        .agg(
            F.count("*").alias("flows"), F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"), F.min("start").alias("first_start"),
            F.max("dstport").alias("max_port"),
        )
    )


DNS = """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ' Q', event_id, ' ip4 10.0.0.', u,
  ' 53 A ', event_type, '.example.com. ', CASE WHEN k < 20 THEN 'NXDOMAIN' ELSE 'NOERROR' END)"""


def dns(spark, sf):
    df = events(spark, sf).withColumn("message", F.expr(DNS))
    return df.select("event_id", "ts", parse.dns_query_line(F.col("message")).alias("q")).select(
        "event_id", "ts", "q.*"
    )


@query(
    "parse_dns_lines",
    f"""WITH {EV} SELECT event_id, '10.0.0.' || u AS srcaddr, 53 AS srcport, 'A' AS record_type,
        event_type || '.example.com' AS name,
        CASE WHEN k < 20 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code FROM ev""",
)
def dns_lines(spark, sf):
    return dns(spark, sf).select(
        "event_id", "srcaddr", "srcport", "record_type", "name", "response_code"
    )


@query(
    "security_dns_volume",
    f"""WITH {EV} SELECT event_type || '.example.com' AS domain, {bucket_sql(900)} AS bucket,
        count(*) AS queries FROM ev GROUP BY 1, 2""",
)
def dns_volume(spark, sf):
    return security.domain_volume(dns(spark, sf)).withColumn("bucket", secs("bucket"))


@query(
    "parse_http_lines",
    f"""WITH {EV} SELECT event_type, method, status_class, client_error, server_error, count(*) AS n,
        CAST(sum(millis) AS BIGINT) AS millis, count(edge) AS edges FROM (
        SELECT event_type, CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END AS method,
          CAST((200 + k * 4) // 100 AS INT) AS status_class, (200 + k * 4) // 100 = 4 AS client_error,
          (200 + k * 4) // 100 = 5 AS server_error,
          CASE WHEN event_type = 'view' THEN NULL ELSE k END AS millis,
          CASE WHEN event_type = 'view' THEN 'Hit' END AS edge FROM ev) GROUP BY 1, 2, 3, 4, 5""",
)
def http_lines(spark, sf):
    text = F.expr(
        """concat(CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END, ' /api/', u, ' ',
           200 + k * 4, CASE WHEN event_type = 'view' THEN ' [Hit]' ELSE concat(' ', k, 'ms') END)"""
    )
    df = events(spark, sf).select("event_type", parse.http_access_line(text).alias("h"))
    status = F.col("h.status")
    return df.groupBy(
        "event_type", F.col("h.method").alias("method"), X.status_class(status).alias("status_class"),
        X.is_client_error(status).alias("client_error"),
        X.is_server_error(status).alias("server_error"),
    ).agg(
        F.count("*").alias("n"), F.sum("h.millis").alias("millis"), F.count("h.edge").alias("edges")
    )


@query(
    "parse_embedded_json",
    f"""WITH {EV} SELECT event_type, count(*) AS n, CAST(count(*) FILTER (event_type <> 'error')
        AS BIGINT) AS present, CAST(sum(CASE WHEN event_type <> 'error' THEN k END) AS BIGINT) AS sum_k
        FROM ev GROUP BY 1""",
)
def embedded(spark, sf):
    """Request parameters kept as text; the literal text null means there are none."""
    text = F.when(F.col("event_type") == "error", "null").otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_type", parse.embedded_json(text).alias("p"))
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("p").alias("present"),
        F.sum(F.try_variant_get("p", "$.k", "bigint")).alias("sum_k"),
    )


@query(
    "parse_coverage",
    f"""WITH {EV} SELECT event_type AS dataset, count(*) AS docs,
        {r4_sql("avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END)")} AS parsed_share
        FROM ev GROUP BY 1""",
)
def coverage(spark, sf):
    df = lines(spark, sf).select(
        F.col("event_type").alias("dataset"), parse.json_value(F.col("message")).alias("parsed")
    )
    return parse.parse_coverage(df).withColumn("parsed_share", r4(F.col("parsed_share")))


@query(
    "join_invocation_lines",
    f"""WITH {EV} SELECT 'r-' || u AS request_id,
        {secs_sql("min(CASE WHEN event_type = 'view' THEN ts END)")} AS started,
        {secs_sql("max(CASE WHEN event_type = 'signup' THEN ts END)")} AS ended,
        count(*) FILTER (event_type IN ('click', 'error')) AS app_lines,
        count(*) FILTER (event_type = 'purchase') AS reports,
        max(CASE WHEN event_type = 'purchase' THEN k + CAST(0.25 AS DOUBLE) END) AS duration_ms,
        CAST(max(CASE WHEN event_type = 'purchase' THEN k + 28 END) AS BIGINT) AS memory_mb
        FROM ev GROUP BY 1""",
)
def invocation_lines(spark, sf):
    out = invocations.assemble(lines(spark, sf))
    return out.withColumns({"started": secs("started"), "ended": secs("ended")})


@query(
    "scalar_time",
    f"""WITH {EV} SELECT event_id, {secs_sql()} AS s, epoch_us(ts) // 1000 AS ms,
        epoch_us(ts) + k * 1000 AS later_us, strftime(ts, '%Y/%m/%d') AS path,
        {secs_sql()} AS again, true AS same_ms FROM ev""",
)
def scalar_time(spark, sf):
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    millis = X.to_epoch_millis(ts)
    return events(spark, sf).select(
        "event_id", X.to_epoch_seconds(ts).alias("s"), millis.alias("ms"),
        F.unix_micros(X.plus_millis(ts, F.col("k"))).alias("later_us"),
        X.date_path(ts).alias("path"),
        X.to_epoch_seconds(X.parse_time(text)).alias("again"),
        (X.to_epoch_millis(X.from_epoch_millis(millis)) == millis).alias("same_ms"),
    )


@query(
    "scalar_units",
    f"""SELECT l_orderkey, l_linenumber, {r4_sql("l_extendedprice * 1000000.0 / 1e9")} AS s,
        {r4_sql("l_extendedprice / 1000.0")} AS ms, {r4_sql("l_extendedprice / 1048576.0")} AS mb,
        CAST(ceil(l_extendedprice / 100) * 100 AS BIGINT) AS billed,
        greatest(CAST(10 AS DOUBLE), least(CAST(40 AS DOUBLE), l_quantity)) AS clamped,
        CAST(l_quantity AS DOUBLE) > 0 AS valid FROM lineitem""",
)
def scalar_units(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r4(X.ns_to_s(price * 1e6)).alias("s"),
        r4(X.us_to_ms(price)).alias("ms"), r4(X.bytes_to_mb(price)).alias("mb"),
        X.billed_millis(price).alias("billed"),
        X.clamp(F.col("l_quantity"), 10.0, 40.0).alias("clamped"),
        X.duration_is_valid(F.col("l_quantity")).alias("valid"),
    )


@query(
    "scalar_severity",
    f"""SELECT severity, count(*) AS n FROM (SELECT CASE WHEN l_linenumber >= 8 THEN 'CRITICAL'
        WHEN l_linenumber >= 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM lineitem) GROUP BY 1""",
)
def severity(spark, sf):
    label = X.severity_label(F.col("l_linenumber")).alias("severity")
    return table(spark, sf, "lineitem").groupBy(label).agg(F.count("*").alias("n"))


@query(
    "scalar_arn",
    """SELECT o_orderkey, 'arn:aws:guardduty:us-east-1:' || o_custkey || ':detector/d1/finding/'
         || o_orderkey AS arn, 'guardduty' AS service, CAST(o_custkey AS VARCHAR) AS account,
         CAST(o_orderkey AS VARCHAR) AS resource FROM orders""",
)
def arns(spark, sf):
    made = X.arn(
        F.lit("guardduty"), F.lit("us-east-1"), F.col("o_custkey").cast("string"),
        F.concat(F.lit("detector/d1/finding/"), F.col("o_orderkey")),
    )
    return table(spark, sf, "orders").select("o_orderkey", made.alias("arn")).select(
        "o_orderkey", "arn", X.arn_part(F.col("arn"), 3).alias("service"),
        X.arn_part(F.col("arn"), 5).alias("account"),
        X.last_segment(F.col("arn")).alias("resource"),
    )


@query(
    "scalar_digests",
    """WITH d AS (SELECT event_id, sha1(event_type || ':' || event_id) AS h,
         sha256(event_type || ':' || event_id) AS digest FROM events)
       SELECT event_id, digest, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3)
         || '-' || CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8'
           WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9'
           WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END
         || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM d""",
)
def digests(spark, sf):
    seed = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return events(spark, sf).select(
        "event_id", X.name_digest(seed).alias("digest"), X.name_uuid(seed).alias("uuid")
    )


@query(
    "scalar_arrays_and_maps",
    f"""WITH {EV} SELECT event_type AS tag, CAST(k AS VARCHAR) AS dim, count(*) AS n FROM ev
        WHERE event_type <> 'error' GROUP BY 1, 2""",
)
def arrays_and_maps(spark, sf):
    df = events(spark, sf).select(
        X.as_list(F.col("event_type")).alias("tags"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("dims"),
    )
    return (
        df.filter(~F.array_contains("tags", "error"))
        .select(F.explode("tags").alias("tag"), X.dimension(F.col("dims"), "k").alias("dim"))
        .groupBy("tag", "dim")
        .agg(F.count("*").alias("n"))
    )


@query(
    "scalar_json_text",
    f"""WITH {EV} SELECT event_id, k, CASE WHEN event_type = 'error' THEN
        '{{"id":' || event_id || '}}' ELSE '{{"id":' || event_id || ',"type":"' || event_type || '"}}'
        END AS doc FROM ev""",
)
def json_text(spark, sf):
    """Keys without a value are left out of the shipped document."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    doc = strip_nulls(F.struct(F.col("event_id").alias("id"), kind.alias("type")))
    return table(spark, sf, "events").select(
        "event_id", X.json_field(F.col("props"), "$.k", "int").alias("k"), doc.alias("doc")
    )


@query(
    "scalar_label_numbers",
    """SELECT event_type, CAST(sum(user_id) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS bad
       FROM events GROUP BY 1""",
)
def label_numbers(spark, sf):
    labels = F.create_map(
        F.lit("tokens"), F.col("u").cast("string"), F.lit("finish"), F.col("event_type")
    )
    df = events(spark, sf).select("event_type", labels.alias("labels"))
    return df.groupBy("event_type").agg(
        F.sum(X.label_number(F.col("labels"), "tokens")).alias("tokens"),
        F.count(X.label_number(F.col("labels"), "finish")).alias("bad"),
    )


@query(
    "enrich_category_list",
    f"""WITH {EV} SELECT event_type, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS items,
        count(*) AS n FROM ev GROUP BY 1, 2""",
)
def category_list(spark, sf):
    """The category is a list in some documents and a bare string in others."""
    text = F.expr(
        """CASE WHEN event_type = 'view' THEN '["web","view"]'
           ELSE concat('"', event_type, '"') END"""
    )
    df = events(spark, sf).withColumn("category", F.try_parse_json(text))
    listed = normalise_category(F.col("category"), df.schema["category"].dataType)
    return df.groupBy("event_type", F.size(listed).alias("items")).agg(F.count("*").alias("n"))


@query(
    "security_denied_by_source",
    """SELECT '10.0.0.' || l_suppkey AS srcaddr, count(*) FILTER (l_linestatus <> 'O') AS denied,
       count(*) AS flows FROM lineitem GROUP BY 1""",
)
def denied(spark, sf):
    return security.denied_by_source(flows(spark, sf))


@query(
    "security_egress_by_destination",
    """SELECT '172.16.0.' || l_partkey AS dstaddr, CAST(sum(CAST(l_quantity AS INT) * 1500) AS BIGINT)
       AS bytes, count(*) AS flows FROM lineitem GROUP BY 1""",
)
def egress(spark, sf):
    return security.egress_by_destination(flows(spark, sf))


# Fixed expectations, written out for the comparison side: dataset, then the columns that it fills.
MOVED = """aws.athena athena__dataScannedBytes athena__database athena__durationSeconds athena__queryId athena__state athena__workgroup
aws.cloudformation cloudformation__action cloudformation__stackName cloudformation__stackStatus
aws.codebuild codebuild__buildId codebuild__phase codebuild__project codebuild__status
aws.codepipeline codepipeline__executionId codepipeline__pipeline codepipeline__stage codepipeline__state
aws.emr_logs emr__applicationId emr__clusterId emr__component emr__containerId log__level
aws.glue error__code glue__jobName glue__jobRunId log__level
aws.iot iot__action iot__clientId iot__topic
aws.qbusiness qbusiness__application_id qbusiness__conversation_id qbusiness__event_type qbusiness__guardrail_action
aws.rds log__level rds__logger rds__thread
aws.sagemaker log__level sagemaker__appType sagemaker__event sagemaker__space sagemaker__user
aws.securitylake securitylake__activity_id securitylake__category_uid securitylake__class_name securitylake__class_uid securitylake__severity_id
aws.ssm ssm__commandId ssm__documentName ssm__instanceId ssm__status
aws.verifiedaccess verifiedaccess__deny_reason verifiedaccess__device_posture verifiedaccess__trust_provider_type verifiedaccess__verdict"""
_ALL = sorted(p.dataset for p in parsers.all_parsers())
_KEYS = sorted({key for p in parsers.all_parsers() for key, _ in p.renames})
_WHEN_MOVED = " ".join(
    f"WHEN '{line.split(' ', 1)[0]}' THEN '{line.split(' ', 1)[1]}'" for line in MOVED.splitlines()
)


@query(
    "parse_every_dataset",
    f"""WITH {EV}, d AS (SELECT k, [{", ".join(f"'{d}'" for d in _ALL)}][CAST(event_id % {len(_ALL)} AS INT) + 1]
          AS dataset FROM ev)
        SELECT dataset, CASE WHEN dataset IN ('aws.ec2_logs', 'aws.emr_logs', 'aws.lambda_logs')
          THEN replace(substr(dataset, 5), '_logs', '') ELSE substr(dataset, 5) END || '.parsed' AS space,
        CASE dataset {_WHEN_MOVED} ELSE '' END AS moved, CASE WHEN dataset IN ('aws.emr_logs', 'aws.glue',
          'aws.rds', 'aws.sagemaker') THEN 'val-' || min(k) END AS level, count(*) AS n FROM d GROUP BY 1""",
)
def every_dataset(spark, sf):
    """A message with every key for every dataset; which columns each parser fills, and with what."""
    names = F.array(*[F.lit(d) for d in _ALL])
    docs = events(spark, sf).select(
        F.get(names, F.pmod(F.col("event_id"), F.lit(len(_ALL))).cast("int")).alias("dataset"), "k",
        F.expr("concat('{', " + _json_pairs() + ", '}')").alias("message"),
    )
    out = parse.parse_documents(docs, parsers.all_parsers())
    moved = sorted(c for c in out.columns if "__" in c)
    filled = F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in moved])
    return (
        out.withColumn("moved", filled)
        .groupBy("dataset", F.col("parsed_as").alias("space"), "moved")
        .agg(F.min_by("log__level", "k").alias("level"), F.count("*").alias("n"))
    )


def _json_pairs() -> str:
    """SQL pieces of a JSON object that gives every key the value Val-<k>."""
    return ", ',', ".join(f"'\"{key}\":\"Val-', k, '\"'" for key in _KEYS)


@query(
    "enrich_strip_variant_nulls",
    f"""WITH {EV} SELECT event_id, '{{"a.b":{{"list":[1,null,{{"y":' || k || '}}]' || CASE WHEN k < 50 THEN ''
          ELSE ',"z":"\\":null,' || k || '"' END || '}}' || CASE WHEN k % 3 = 0 THEN '' ELSE ',"m":' || k END
          || ',"t":"' || event_type || ',"}}' AS doc FROM ev""",
)
def strip_variant_nulls(spark, sf):
    """E1 inside a VARIANT: null fields go at any depth, elements of arrays, keys with dots and texts that
    look like fields stay."""
    text = F.expr(
        """concat('{"a.b":{"gone":null,"list":[1,null,{"x":null,"y":', k, ',"yy":null}],"z":', """
        """CASE WHEN k < 50 THEN 'null' ELSE concat('"\\\\":null,', k, '"') END, '},"m":', """
        """CASE WHEN k % 3 = 0 THEN 'null' ELSE CAST(k AS STRING) END, ',"n":null,"t":"', event_type, ',","u":null}')"""
    )
    doc = strip_variant_nulls_of(F.try_parse_json(text))
    return events(spark, sf).select("event_id", F.to_json(doc).alias("doc"))

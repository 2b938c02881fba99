"""T*, J3, J4, J9, J10, W6: traces from orders and line items, and from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql, table
from skyledger.catalog.detection import scores_over, shaped
from skyledger.operators import detect as D
from skyledger.operators import invocations
from skyledger.operators import traces as T
from skyledger.plans.jobs import jobs_of

# An order is a transaction, its line items are spans. Spans run in the supplier's service and
# call the part as a resource; returned items failed.
SPANS = """sp AS (
  SELECT o_orderdate AS ts, 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS id,
    CAST(NULL AS VARCHAR) AS parent_id, 'o' || o_orderkey AS transaction_id, 'transaction' AS kind,
    o_orderpriority AS name, 'request' AS type, CAST(NULL AS VARCHAR) AS subtype,
    CAST(floor(o_totalprice) AS BIGINT) AS us,
    CASE o_orderstatus WHEN 'F' THEN 'failure' ELSE 'success' END AS outcome,
    o_orderpriority AS service, CAST(NULL AS VARCHAR) AS destination, 4 AS started FROM orders
  UNION ALL
  SELECT l_shipdate, 't' || l_orderkey, 'i' || l_orderkey || '-' || l_linenumber || '-' || l_partkey
      || '-' || l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'x' ELSE 'o' END || l_orderkey,
    'o' || l_orderkey, 'span', 'call ' || l_linenumber,
    CASE l_returnflag WHEN 'A' THEN 'db' WHEN 'N' THEN 'external' ELSE 'messaging' END,
    CASE l_returnflag WHEN 'A' THEN 'spark' WHEN 'N' THEN 'http' ELSE 'sqs' END,
    CAST(floor(l_extendedprice / 10) AS BIGINT),
    CASE l_returnflag WHEN 'R' THEN 'failure' ELSE 'success' END,
    'svc-' || l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'db-' || l_linenumber END, NULL
  FROM lineitem)"""


def spans(spark, sf):
    """The same rows in the span layout; finished items point to a parent that is missing."""
    none = F.lit(None).cast("string")
    oid = F.concat(F.lit("o"), "o_orderkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("t"), "o_orderkey").alias("trace_id"), oid.alias("id"),
        none.alias("parent_id"), oid.alias("transaction_id"), F.lit("transaction").alias("kind"),
        F.col("o_orderpriority").alias("name"), F.lit("request").alias("type"),
        none.alias("subtype"), F.floor("o_totalprice").alias("duration_us"),
        F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("outcome"),
        F.col("o_orderpriority").alias("service_name"), none.alias("destination"),
        F.lit(4).alias("span_started"),
    )
    flag, key = F.col("l_returnflag"), F.col("l_orderkey")
    items = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("t"), key).alias("trace_id"),
        F.concat(
            F.lit("i"), F.concat_ws("-", key, "l_linenumber", "l_partkey", "l_suppkey")
        ).alias("id"),
        F.concat(F.when(F.col("l_linestatus") == "F", "x").otherwise("o"), key).alias("parent_id"),
        F.concat(F.lit("o"), key).alias("transaction_id"), F.lit("span").alias("kind"),
        F.concat(F.lit("call "), "l_linenumber").alias("name"),
        F.when(flag == "A", "db").when(flag == "N", "external").otherwise("messaging").alias("type"),
        F.when(flag == "A", "spark").when(flag == "N", "http").otherwise("sqs").alias("subtype"),
        F.floor(F.col("l_extendedprice") / 10).alias("duration_us"),
        F.when(flag == "R", "failure").otherwise("success").alias("outcome"),
        F.concat(F.lit("svc-"), "l_linenumber").alias("service_name"),
        F.when(flag == "A", F.concat(F.lit("db-"), "l_linenumber")).alias("destination"),
        F.lit(None).cast("int").alias("span_started"),
    )
    return orders.unionByName(items)


def conversation_spans(spark, sf):
    """A conversation is a trace, a turn is a span below the turn before it."""
    turn = F.col("turn")
    labels = F.create_map(
        F.lit("gen_ai_request_model"), F.col("role"),
        F.lit("gen_ai_usage_input_tokens"), F.length("text").cast("string"),
        F.lit("gen_ai_usage_output_tokens"),
        F.when(turn > 1, turn.cast("string")).otherwise("n/a"),
        F.lit("parent_trace_id"),
        F.when(turn == 0, F.concat(F.lit("c"), F.col("conv_id") - 1)),
        F.lit("aws.xray.trace_id"), F.col("conv_id").cast("string"),
    )
    return table(spark, sf, "conversations").select(
        F.timestamp_seconds(F.col("conv_id") * 100 + turn * 7).alias("ts"),
        F.concat(F.lit("c"), "conv_id").alias("trace_id"),
        turn.cast("string").alias("id"),
        F.when(turn > 0, (turn - 1).cast("string")).alias("parent_id"),
        F.lit("0").alias("transaction_id"),
        F.when(turn == 0, "transaction").otherwise("span").alias("kind"),
        F.concat(F.lit("turn "), F.col("role")).alias("name"),
        F.col("role").alias("service_name"), F.length("text").cast("bigint").alias("duration_us"),
        F.lit("success").alias("outcome"), (turn == 0).alias("coldstart"), labels.alias("labels"),
        F.col("conv_id"),
    )


@query(
    "traces_unified_table",
    "SELECT role, count(*) AS spans, CAST(sum(length(text)) AS BIGINT) AS us, "
    "count(*) FILTER (turn = 0) AS roots FROM conversations GROUP BY 1",
)
def unified(spark, sf):
    """Trace documents as VARIANT, projected to one table."""
    turn = F.col("turn")
    tx = F.when(turn == 0, F.struct(
        F.lit("0").alias("id"), F.lit("chat").alias("name"),
        F.struct(F.length("text").alias("us")).alias("duration"),
    ))
    sp = F.when(turn > 0, F.struct(
        turn.cast("string").alias("id"), F.lit("turn").alias("name"),
        F.struct(F.length("text").alias("us")).alias("duration"),
    ))
    doc = F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("@timestamp"),
        F.struct(F.when(turn == 0, "transaction").otherwise("span").alias("event")).alias("processor"),
        F.struct(F.col("conv_id").cast("string").alias("id")).alias("trace"),
        F.struct(F.when(turn > 0, (turn - 1).cast("string")).alias("id")).alias("parent"),
        tx.alias("transaction"), sp.alias("span"), F.struct(F.col("role").alias("name")).alias("service"),
    )
    docs = table(spark, sf, "conversations").select(F.try_parse_json(F.to_json(doc)).alias("doc"))
    return T.spans_table(docs).groupBy(F.col("service_name").alias("role")).agg(
        F.count("id").alias("spans"), F.sum("duration_us").alias("us"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
    )


@query(
    "traces_with_parent",
    f"""WITH {SPANS} SELECT c.kind, p.service AS parent_service_name, count(*) AS n,
        CAST(sum(c.us) AS BIGINT) AS us FROM sp c LEFT JOIN sp p ON p.trace_id = c.trace_id
        AND p.id = c.parent_id GROUP BY 1, 2""",
)
def with_parent(spark, sf):
    out = T.with_parent(spans(spark, sf), "service_name")
    return out.groupBy("kind", "parent_service_name").agg(
        F.count("*").alias("n"), F.sum("duration_us").alias("us")
    )


@query(
    "traces_orphans",
    f"""WITH {SPANS} SELECT service, count(*) AS n FROM sp c WHERE parent_id IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM sp p WHERE p.trace_id = c.trace_id AND p.id = c.parent_id) GROUP BY 1""",
)
def orphans(spark, sf):
    out = T.orphans(spans(spark, sf))
    return out.groupBy(F.col("service_name").alias("service")).agg(F.count("*").alias("n"))


@query(
    "traces_validate",
    f"""WITH {SPANS}, o AS (SELECT c.trace_id, count(*) AS n FROM sp c WHERE parent_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM sp p WHERE p.trace_id = c.trace_id AND p.id = c.parent_id)
          GROUP BY 1)
        SELECT sp.trace_id, count(*) AS docs, count(*) FILTER (parent_id IS NULL) AS roots,
          coalesce(max(o.n), 0) AS orphans, count(*) >= 2 AND count(*) FILTER (parent_id IS NULL) >= 1
          AND coalesce(max(o.n), 0) = 0 AS valid
        FROM sp LEFT JOIN o ON o.trace_id = sp.trace_id GROUP BY 1""",
)
def validate(spark, sf):
    return T.validate(spans(spark, sf))


@query(
    "traces_depth",
    """SELECT conv_id, CAST(turn AS VARCHAR) AS id, turn AS depth, '0' AS top FROM conversations""",
)
def depth(spark, sf):
    """A turn lies as deep as its number; found by pointer doubling."""
    df = conversation_spans(spark, sf)
    out = T.depths(df)
    ids = df.select("trace_id", "conv_id").distinct()
    return out.join(ids, "trace_id").select("conv_id", "id", "depth", "top")


@query(
    "traces_depth_geography",
    """SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS depth FROM region
       UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation
       UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier
       UNION ALL SELECT 'c' || c_custkey, 2 FROM customer""",
)
def depth_geography(spark, sf):
    """T3 over one tree of regions, nations, suppliers and customers."""
    def node(name, own, prefix, up=None, up_prefix=""):
        above = F.concat(F.lit(up_prefix), up) if up else F.lit(None).cast("string")
        return table(spark, sf, name).select(
            F.lit("world").alias("trace_id"), F.concat(F.lit(prefix), own).alias("id"),
            above.alias("parent_id"),
        )

    tree = (
        node("region", "r_regionkey", "r")
        .unionByName(node("nation", "n_nationkey", "n", "n_regionkey", "r"))
        .unionByName(node("supplier", "s_suppkey", "s", "s_nationkey", "n"))
        .unionByName(node("customer", "c_custkey", "c", "c_nationkey", "n"))
    )
    return T.depths(tree).select("id", "depth")


@query(
    "traces_service_map",
    f"""WITH {SPANS}, e AS (
          SELECT p.service AS caller, c.service AS callee, c.outcome, c.us FROM sp c JOIN sp p
            ON p.trace_id = c.trace_id AND p.id = c.parent_id WHERE p.service <> c.service
          UNION ALL SELECT service, destination, outcome, us FROM sp WHERE destination IS NOT NULL)
        SELECT caller, callee, CAST(count(*) AS BIGINT) AS calls,
          {r4_sql("avg(CASE WHEN outcome = 'failure' THEN 1.0 ELSE 0.0 END)")} AS error_rate,
          {r4_sql("avg(us)")} AS avg_us FROM e GROUP BY 1, 2""",
)
def service_map(spark, sf):
    out = T.service_map(spans(spark, sf))
    return out.withColumns({"error_rate": r4(F.col("error_rate")), "avg_us": r4(F.col("avg_us"))})


@query(
    "traces_dependencies",
    f"""WITH {SPANS} SELECT service AS service_name, destination, count(*) AS calls,
        {r4_sql("avg(us)")} AS avg_us FROM sp WHERE destination IS NOT NULL GROUP BY 1, 2""",
)
def dependencies(spark, sf):
    return T.dependencies(spans(spark, sf)).withColumn("avg_us", r4(F.col("avg_us")))


@query(
    "traces_transaction_stats",
    f"""WITH {SPANS} SELECT name, count(*) AS count, {r4_sql("avg(us)")} AS avg FROM sp
        WHERE kind = 'transaction' GROUP BY 1 ORDER BY count DESC, name""",
)
def transaction_stats(spark, sf):
    return T.transaction_stats(spans(spark, sf)).withColumn("avg", r4(F.col("avg")))


@query(
    "traces_span_stats",
    f"""WITH {SPANS} SELECT type, subtype, count(*) AS count, {r4_sql("avg(us)")} AS avg FROM sp
        WHERE kind = 'span' GROUP BY 1, 2 ORDER BY count DESC, 1, 2""",
)
def span_stats(spark, sf):
    return T.span_stats(spans(spark, sf)).withColumn("avg", r4(F.col("avg")))


@query(
    "traces_self_time",
    f"""WITH {SPANS}, c AS (SELECT trace_id, parent_id AS id, CAST(sum(us) AS BIGINT) AS child_us
          FROM sp WHERE parent_id IS NOT NULL GROUP BY 1, 2)
        SELECT sp.trace_id, sp.id, us, coalesce(child_us, 0) AS child_us,
          greatest(us - coalesce(child_us, 0), 0) AS self_us
        FROM sp LEFT JOIN c ON c.trace_id = sp.trace_id AND c.id = sp.id""",
)
def self_time(spark, sf):
    return T.self_time(spans(spark, sf)).select(
        "trace_id", "id", F.col("duration_us").alias("us"), "child_us", "self_us"
    )


@query(
    "traces_span_count_check",
    f"""WITH {SPANS}, s AS (SELECT trace_id, count(*) AS n FROM sp WHERE kind = 'span' GROUP BY 1)
        SELECT sp.id, started AS span_started, coalesce(n, 0) AS observed,
          started - coalesce(n, 0) AS missing FROM sp LEFT JOIN s ON s.trace_id = sp.trace_id
        WHERE kind = 'transaction'""",
)
def span_count_check(spark, sf):
    return T.span_count_check(spans(spark, sf)).select("id", "span_started", "observed", "missing")


@query(
    "traces_service_health",
    f"""WITH {SPANS} SELECT service AS service_name, {bucket_sql(604800)} AS bucket,
        count(*) AS requests, {r4_sql("avg(CASE WHEN outcome = 'failure' THEN 1.0 ELSE 0.0 END)")}
        AS error_rate, {r4_sql("avg(us)")} AS avg_us FROM sp WHERE kind = 'transaction'
        GROUP BY 1, 2""",
)
def service_health(spark, sf):
    out = T.service_health(spans(spark, sf), "7 days")
    return out.withColumns(
        {
            "bucket": secs("bucket"),
            "error_rate": r4(F.col("error_rate")),
            "avg_us": r4(F.col("avg_us")),
        }
    )


@query(
    "traces_cold_start_rate",
    f"""SELECT u AS service_name, count(*) AS invocations, {r4_sql("avg(cold)")} AS rate FROM (
        SELECT 'fn-' || user_id AS u, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END AS cold
        FROM events) GROUP BY 1""",
)
def cold_start_rate(spark, sf):
    df = events(spark, sf).select(
        F.concat(F.lit("fn-"), "u").alias("service_name"), F.lit("transaction").alias("kind"),
        (F.col("event_type") == "view").alias("coldstart"),
    )
    return T.cold_start_rate(df).withColumn("rate", r4(F.col("rate")))


def errors(spark, sf):
    """Error events as error documents with a library frame above an application frame."""
    frame = lambda name, line, lib: F.struct(
        name.alias("function"), F.lit("app.py").alias("filename"), line.alias("lineno"),
        F.lit(lib).alias("library_frame"),
    )
    k = F.col("k").cast("string")
    exception = F.struct(
        F.concat(F.lit("Error"), F.floor(F.col("k") / 10).cast("string")).alias("type"),
        F.lit("failed").alias("message"), (F.col("k") < 50).alias("handled"),
        F.array(
            frame(F.lit("lib"), F.lit(1), True),
            frame(F.concat(F.lit("f"), k), F.lit(2), False),
        ).alias("stacktrace"),
    )
    return events(spark, sf).filter(F.col("event_type") == "error").select(
        "ts", F.md5(F.col("event_id").cast("string")).alias("error_id"),
        F.when(F.col("k") < 90, F.md5(F.col("u").cast("string"))).alias("trace_id"),
        F.concat(F.lit("o"), "event_id").alias("parent_id"),
        F.concat(F.lit("svc-"), "u").alias("service_name"),
        F.concat(F.lit("handler "), F.floor(F.col("k") / 25).cast("string")).alias("culprit"),
        F.array(exception).alias("exception"), "event_id",
    )


@query(
    "traces_error_groups",
    f"""SELECT 'svc-' || u AS service_name, 'Error' || k // 10 AS exception_type,
        'handler ' || k // 25 AS culprit, count(*) AS errors, count(*) FILTER (k >= 50) AS unhandled,
        min({secs_sql()}) AS first_seen, max({secs_sql()}) AS last_seen, min('app.py:f' || k) AS top_frame
        FROM (SELECT ts, user_id AS u, CAST(props->>'$.k' AS INT) AS k FROM events
          WHERE event_type = 'error') GROUP BY 1, 2, 3""",
)
def error_groups(spark, sf):
    out = T.error_groups(errors(spark, sf))
    return out.withColumns({"first_seen": secs("first_seen"), "last_seen": secs("last_seen")})


@query(
    "quality_error_documents",
    """SELECT rule, count(*) AS checked, CAST(sum(bad) AS BIGINT) AS failed FROM (
        SELECT unnest(['error_id', 'trace_id', 'exception_type', 'exception_message']) AS rule,
          unnest([0, CASE WHEN CAST(props->>'$.k' AS INT) >= 90 THEN 1 ELSE 0 END, 0, 0]) AS bad
        FROM events WHERE event_type = 'error') GROUP BY 1""",
)
def error_documents(spark, sf):
    from skyledger.operators import quality

    return quality.rule_report(errors(spark, sf), quality.error_rules())


@query(
    "traces_error_context",
    f"""WITH {SPANS} SELECT e.event_id, sp.kind AS at_kind, sp.name AS at_name, sp.us AS at_us
        FROM events e LEFT JOIN sp ON sp.id = 'o' || e.event_id AND sp.kind = 'transaction'
        WHERE e.event_type = 'error'""",
)
def error_context(spark, sf):
    """Error events at the order with their number; unknown orders stay."""
    lost = errors(spark, sf).withColumn("trace_id", F.concat(F.lit("t"), "event_id"))
    out = T.error_context(lost, spans(spark, sf))
    return out.select("event_id", "at_kind", "at_name", "at_us")


@query(
    "traces_linked",
    """SELECT 'c' || conv_id AS trace_id, 'c' || (conv_id - 1) AS upstream,
         (SELECT min(role) FROM conversations p WHERE p.conv_id = c.conv_id - 1 AND p.turn = 0)
         AS upstream_service FROM conversations c WHERE turn = 0""",
)
def linked(spark, sf):
    """The upstream trace is absent for the first conversation."""
    out = T.linked_traces(conversation_spans(spark, sf))
    return out.select("trace_id", "upstream", "upstream_service")


@query(
    "traces_by_label",
    """SELECT conv_id, turn, o_orderpriority FROM conversations
       JOIN orders ON o_orderkey = conv_id""",
)
def by_label(spark, sf):
    """Spans meet a second tracing table by an id kept in their labels."""
    other = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("xray_id"), "o_orderpriority"
    )
    out = T.by_label(conversation_spans(spark, sf), other, "aws.xray.trace_id", "xray_id")
    return out.select("conv_id", F.col("id").cast("bigint").alias("turn"), "o_orderpriority")


@query(
    "traces_log_context",
    """SELECT e.event_id, c.role AS root_service FROM events e LEFT JOIN conversations c
       ON c.conv_id = e.event_id AND c.turn = 0""",
)
def log_context(spark, sf):
    """Log lines with the root of the trace they name; error lines name none."""
    logs = events(spark, sf).select("event_id", F.concat(F.lit("c"), "event_id").alias("trace_id"))
    out = invocations.with_traces(logs, conversation_spans(spark, sf))
    return out.select("event_id", "root_service")


@query(
    "traces_repeated_spans",
    f"""WITH {SPANS} SELECT trace_id, name, count(*) AS attempts,
        count(*) FILTER (outcome = 'failure') AS failed FROM sp WHERE kind = 'span'
        AND trace_id IN (SELECT trace_id FROM sp WHERE subtype = 'sqs') GROUP BY 1, 2
        HAVING count(*) > 1""",
)
def repeated_spans(spark, sf):
    return T.repeated_spans(spans(spark, sf))


@query(
    "traces_fan_out",
    f"""WITH {SPANS} SELECT trace_id, parent_id, count(*) AS width FROM sp
        WHERE parent_id IS NOT NULL GROUP BY 1, 2""",
)
def fan_out(spark, sf):
    return T.fan_out(spans(spark, sf))


@query(
    "traces_token_usage",
    """SELECT role AS model, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens,
       CAST(sum(CASE WHEN turn > 1 THEN turn END) AS BIGINT) AS output_tokens
       FROM conversations GROUP BY 1""",
)
def token_usage(spark, sf):
    return T.token_usage(conversation_spans(spark, sf))


@query(
    "traces_stage_durations",
    f"""WITH {SPANS} SELECT service AS service_name, {bucket_sql(86400)} AS bucket,
        count(*) AS stages, {r4_sql("avg(us)")} AS avg_us FROM sp WHERE subtype = 'spark'
        GROUP BY 1, 2""",
)
def stage_durations(spark, sf):
    out = T.stage_durations(spans(spark, sf), span="1 day")
    return out.withColumns({"bucket": secs("bucket"), "avg_us": r4(F.col("avg_us"))})


FEED = f"""WITH {SPANS}
  SELECT 'apm-traces/apm-transaction-duration-anomaly' AS job, 'high_mean' AS fn, service AS entity, ts,
    CAST(us AS DOUBLE) AS m FROM sp WHERE kind = 'transaction'
  UNION ALL SELECT 'apm-traces/apm-error-rate-spike', 'high_count', service, ts, NULL FROM sp
    WHERE kind = 'transaction' AND outcome = 'failure'
  UNION ALL SELECT 'apm-traces/apm-service-throughput-drop', 'low_count', service, ts, NULL FROM sp
    WHERE kind = 'transaction'
  UNION ALL SELECT 'apm-traces/apm-slow-span-by-type', 'high_mean',
    CASE WHEN kind = 'span' THEN type ELSE '' END, ts, CASE WHEN kind = 'span' THEN us END FROM sp
  UNION ALL SELECT 'apm-traces/apm-emr-stage-duration-anomaly', 'high_mean', '', ts, us FROM sp
    WHERE subtype = 'spark'"""


@query(
    "traces_detect",
    f"""WITH {scores_over(FEED, seconds=86400)} SELECT job, entity, b, function,
        {r4_sql("actual")} AS actual, {r4_sql("score")} AS score, seen FROM scores""",
)
def detect(spark, sf):
    """The trace detectors over the span table, in buckets of a day."""
    return shaped(D.detect(T.detector_documents(spans(spark, sf)), jobs_of("apm-traces"), "1 day"))


@query(
    "traces_sample",
    f"""WITH {SPANS} SELECT kind, count(*) AS n FROM sp
        WHERE CAST('0x' || left(md5(trace_id), 8) AS BIGINT) < {int(0.1 * 2**32)} GROUP BY 1""",
)
def sample(spark, sf):
    """A tenth of the traces, whole."""
    return T.sample_traces(spans(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "window_sibling_gaps",
    f"""WITH {SPANS}, g AS (SELECT trace_id, parent_id, id, epoch_us(ts) - lag(epoch_us(ts) + us)
          OVER (PARTITION BY trace_id, parent_id ORDER BY epoch_us(ts), id) AS gap_us
          FROM (SELECT DISTINCT trace_id, parent_id, id, ts, us FROM sp WHERE parent_id IS NOT NULL))
        SELECT trace_id, parent_id, id, gap_us FROM g""",
)
def sibling_gaps(spark, sf):
    """Identical copies of a span are dropped first, so that the order is total."""
    df = spans(spark, sf).dropDuplicates(["trace_id", "parent_id", "id", "ts", "duration_us"])
    return T.sibling_gaps(df, 30 * 86400).select("trace_id", "parent_id", "id", "gap_us")


@query(
    "traces_path",
    """WITH RECURSIVE n AS (
          SELECT conv_id, CAST(turn AS VARCHAR) AS id, role, CASE WHEN turn = 3 AND conv_id % 5 = 1 THEN 'x'
            WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) WHEN conv_id % 7 = 3 THEN '2' END AS parent
          FROM conversations),
        walk AS (
          SELECT n.conv_id, n.id, CAST(0 AS BIGINT) AS depth, n.id AS top, n.role AS path FROM n
            LEFT JOIN n p ON p.conv_id = n.conv_id AND p.id = n.parent WHERE p.id IS NULL
          UNION ALL SELECT c.conv_id, c.id, w.depth + 1, w.top, w.path || ' > ' || c.role
            FROM walk w JOIN n c ON c.conv_id = w.conv_id AND c.parent = w.id)
        SELECT n.conv_id, n.id, w.depth, w.top, w.path FROM n
        LEFT JOIN walk w ON w.conv_id = n.conv_id AND w.id = n.id""",
)
def path(spark, sf):
    """Roles from the top of the branch to each turn. Some turns lost their parent and start a branch,
    some conversations go in a circle and have no path."""
    turn, conv = F.col("id").cast("int"), F.col("conv_id")
    parent = F.when((turn == 3) & (conv % 5 == 1), "x").when(turn > 0, F.col("parent_id")).when(
        conv % 7 == 3, "2"
    )
    df = conversation_spans(spark, sf).withColumn("parent_id", parent)
    found = T.paths(df, label="service_name")
    ids = df.select("trace_id", "conv_id").distinct()
    return found.join(ids, "trace_id").select(
        "conv_id", "id", "depth", "top", F.array_join("path", " > ").alias("path")
    )


@query(
    "traces_path_profile",
    f"""WITH {SPANS}, ch AS (SELECT trace_id, parent_id AS id, sum(us) AS us FROM sp
          WHERE parent_id IS NOT NULL GROUP BY 1, 2),
        n AS (SELECT trace_id, id, min(parent_id) AS parent_id, min(service) AS service FROM sp GROUP BY 1, 2),
        pa AS (SELECT n.trace_id, n.id, CASE WHEN p.id IS NULL THEN n.service ELSE p.service || ' > ' || n.service
          END AS path FROM n LEFT JOIN n p ON p.trace_id = n.trace_id AND p.id = n.parent_id)
        SELECT path, count(*) AS spans, count(DISTINCT c.trace_id) AS traces, CAST(sum(c.us) AS BIGINT) AS total_us,
          CAST(sum(greatest(c.us - coalesce(ch.us, 0), 0)) AS BIGINT) AS self_us
        FROM sp c JOIN pa ON pa.trace_id = c.trace_id AND pa.id = c.id
        LEFT JOIN ch ON ch.trace_id = c.trace_id AND ch.id = c.id GROUP BY 1""",
)
def path_profile(spark, sf):
    """The call tree of all traces laid over each other."""
    out = T.path_profile(spans(spark, sf), "service_name")
    return out.withColumn("path", F.array_join("path", " > "))


@query(
    "traces_retry_chain",
    f"""WITH {EV}, s AS (SELECT 't' || u AS trace_id, 'call ' || k % 3 AS name, epoch_us(ts) AS us, event_id AS id,
          event_type = 'purchase' AS queue, CASE WHEN event_type IN ('click', 'error', 'signup') THEN 'F'
          ELSE 'S' END AS sym FROM ev),
        names AS (SELECT DISTINCT trace_id, name FROM s WHERE NOT queue),
        seq AS (SELECT trace_id, name, us, id, sym FROM s WHERE NOT queue UNION ALL
          SELECT n.trace_id, n.name, q.us, q.id, 'Q' FROM s q JOIN names n ON n.trace_id = q.trace_id WHERE q.queue),
        f AS (SELECT *, CASE WHEN lag(sym) OVER w = sym THEN 0 ELSE 1 END AS fresh FROM seq
          WINDOW w AS (PARTITION BY trace_id, name ORDER BY us, id)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id, name ORDER BY us, id) AS no FROM f),
        r AS (SELECT trace_id, name, no, sym, count(*) AS n, min(us) AS a, max(us) AS b FROM g GROUP BY 1, 2, 3, 4),
        l AS (SELECT *, lead(sym) OVER w AS s1, lead(a) OVER w AS a1, lead(sym, 2) OVER w AS s2,
          lead(a, 2) OVER w AS a2 FROM r WINDOW w AS (PARTITION BY trace_id, name ORDER BY no))
        SELECT trace_id, name, n AS attempts, a AS first_at, b AS last_at, a1 AS queued_at,
          CASE WHEN s2 = 'S' THEN a2 END AS recovered_at FROM l WHERE sym = 'F' AND n >= 2 AND s1 = 'Q'""",
)
def retry_chain(spark, sf):
    """Failures in a row, then the queue, in this order; the comparison puts every queue span into the
    sequence of every name."""
    failed = F.col("event_type").isin("click", "error", "signup")
    df = events(spark, sf).select(
        F.concat(F.lit("t"), "u").alias("trace_id"), F.concat(F.lit("call "), F.col("k") % 3).alias("name"),
        "ts", F.col("event_id").alias("id"), F.lit("span").alias("kind"),
        F.when(F.col("event_type") == "purchase", "sqs").alias("subtype"),
        F.when(failed, "failure").otherwise("success").alias("outcome"),
    )
    out = T.retry_chains(df, chunk_seconds=6 * 3600)
    times = [F.unix_micros(c).alias(c) for c in ("first_at", "last_at", "queued_at", "recovered_at")]
    return out.select("trace_id", "name", "attempts", *times)

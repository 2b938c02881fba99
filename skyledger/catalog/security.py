"""C*, J5-J7: findings, chains and posture over events, orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql, table
from skyledger.operators import security as C

ACTION = (
    "CASE event_type WHEN 'view' THEN 'ListUsers' WHEN 'click' THEN 'CreateAccessKey' "
    "WHEN 'signup' THEN 'AttachUserPolicy' WHEN 'purchase' THEN 'AssumeRole' "
    "ELSE 'DescribeInstances' END"
)
ACTOR = ["user_name", "source_ip", "access_key"]
DAY = 86400
CALLS = (
    f"{EV}, calls AS (SELECT *, {ACTION} AS action, {secs_sql()} AS sec, epoch_us(ts) AS us, "
    f"{bucket_sql(DAY)} AS day FROM ev)"
)


def calls(spark, sf):
    """Events as API calls; a user always comes from one address with one key."""
    return events(spark, sf).select(
        "event_id", "ts", F.expr(ACTION).alias("action"), "u", "k",
        F.concat(F.lit("user-"), "u").alias("user_name"),
        F.concat(F.lit("10.0.0."), "u").alias("source_ip"),
        F.concat(F.lit("AK"), "u").alias("access_key"),
    )


@query(
    "security_finding_lineage",
    """SELECT o_orderkey, 'sh-' || l_orderkey AS hub_id, event_id FROM orders
       LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey = o_orderkey
       LEFT JOIN events ON event_id = l_orderkey""",
)
def finding_lineage(spark, sf):
    """Orders are detections, orders with items were promoted, events are lake findings."""
    finding = lambda c: F.concat(F.lit("arn:aws:guardduty:finding/"), c)
    detections = table(spark, sf, "orders").select(
        finding(F.col("o_orderkey")).alias("arn"), "o_orderkey"
    )
    hub = table(spark, sf, "lineitem").select("l_orderkey").distinct().select(
        F.concat(F.lit("sh-"), "l_orderkey").alias("hub_id"),
        F.array(F.struct(finding(F.col("l_orderkey")).alias("id"))).alias("related_findings"),
    )
    lake = events(spark, sf).select(
        F.concat(F.lit("sh-"), "event_id").alias("finding_uid"), "event_id"
    )
    return C.finding_lineage(detections, hub, lake).select("o_orderkey", "hub_id", "event_id")


@query(
    "security_chain_counts",
    f"""WITH {CALLS} SELECT u, day AS bucket, count(*) FILTER (action = 'ListUsers') AS n1,
        count(*) FILTER (action = 'CreateAccessKey') AS n2,
        count(*) FILTER (action = 'AttachUserPolicy') AS n3,
        count(*) FILTER (action = 'AssumeRole') AS n4 FROM calls GROUP BY 1, 2
        HAVING n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0""",
)
def chain_counts(spark, sf):
    out = C.chain_counts(calls(spark, sf), [*ACTOR, "u"], "1 day")
    steps = [F.col(f"n_{s}").alias(f"n{i + 1}") for i, s in enumerate(C.ESCALATION_STEPS)]
    return out.select("u", secs("bucket").alias("bucket"), *steps)


@query(
    "security_ordered_chains",
    f"""WITH {CALLS}, c AS (SELECT d.u, d.us AS chain_end, max(a.us) AS chain_start
          FROM calls d JOIN calls e ON e.u = d.u AND e.action = 'AttachUserPolicy'
            AND e.us <= d.us AND e.us >= d.us - {2 * DAY * 1000000}
          JOIN calls b ON b.u = d.u AND b.action = 'CreateAccessKey' AND b.us <= e.us
            AND b.us >= d.us - {2 * DAY * 1000000}
          JOIN calls a ON a.u = d.u AND a.action = 'ListUsers' AND a.us <= b.us
            AND a.us >= d.us - {2 * DAY * 1000000}
          WHERE d.action = 'AssumeRole' GROUP BY 1, 2)
        SELECT u, CAST(chain_start // 1000000 AS BIGINT) AS chain_start,
          CAST(chain_end // 1000000 AS BIGINT) AS chain_end FROM c""",
)
def ordered_chains(spark, sf):
    """The plan keeps running maxima; the comparison joins every combination."""
    out = C.ordered_chains(calls(spark, sf), [*ACTOR, "u"], 2 * DAY)
    return out.select(
        "u", secs("chain_start").alias("chain_start"), secs("chain_end").alias("chain_end")
    )


HALF_DAY = 43200


@query(
    "security_exfiltration",
    f"""WITH {CALLS}, f AS (SELECT u, sec, count(*) AS findings FROM calls
          WHERE event_type = 'error' GROUP BY 1, 2)
        SELECT 'ip-' || f.u AS ip, f.sec AS found_at, f.findings,
          count(*) FILTER (c.event_type = 'view') AS data_events,
          {r4_sql("sum(CASE WHEN c.event_type = 'purchase' THEN c.v ELSE 0 END)")} AS egress_bytes
        FROM f JOIN calls c ON c.u = f.u AND c.sec BETWEEN f.sec - {HALF_DAY} AND f.sec + {HALF_DAY}
        GROUP BY 1, 2, 3
        HAVING count(*) FILTER (c.event_type = 'view') >= 1
          AND sum(CASE WHEN c.event_type = 'purchase' THEN c.v ELSE 0 END) > 10""",
)
def exfiltration(spark, sf):
    """Errors are findings, views data events, purchases flows to the same address."""
    base = events(spark, sf).select(
        "event_type", "ts", F.concat(F.lit("ip-"), "u").alias("ip"), F.col("v").alias("bytes")
    )
    part = lambda kind: base.filter(F.col("event_type") == kind)
    out = C.exfiltration(
        part("error"), part("view"), part("purchase"), HALF_DAY, min_events=1, min_bytes=10
    )
    return out.select(
        "ip", secs("found_at").alias("found_at"), "findings", "data_events",
        r4(F.col("egress_bytes")).alias("egress_bytes"),
    )


@query(
    "security_tactics",
    f"""WITH {EV} SELECT tactic_id, technique_id, count(*) AS docs FROM (SELECT
        CASE event_type WHEN 'view' THEN 'TA0007' WHEN 'click' THEN 'TA0003'
          WHEN 'purchase' THEN 'TA0010' END AS tactic_id, 'T' || k AS technique_id FROM ev)
        WHERE tactic_id IS NOT NULL GROUP BY 1, 2""",
)
def tactics(spark, sf):
    tactic = F.expr(
        "CASE event_type WHEN 'view' THEN 'TA0007' WHEN 'click' THEN 'TA0003' "
        "WHEN 'purchase' THEN 'TA0010' END"
    )
    technique = F.struct(F.concat(F.lit("T"), "k").alias("id"))
    threat = F.struct(F.struct(tactic.alias("id")).alias("tactic"), technique.alias("technique"))
    return C.tactics(events(spark, sf).select(threat.alias("threat")))


@query(
    "security_posture",
    f"""SELECT lang AS section, count(*) AS checks, {r4_sql("avg(CAST(quality AS DOUBLE))")}
        AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def posture(spark, sf):
    """Labelled documents as rule results, language as benchmark section."""
    results = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("evaluation")
    )
    sections = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("section"))
    out = C.posture(sections.join(results, "doc_id"))
    return out.withColumn("pass_rate", r4(F.col("pass_rate")))


@query(
    "security_ocsf_counts",
    f"""WITH {EV} SELECT CASE event_type WHEN 'view' THEN 4001 WHEN 'click' THEN 6003
        WHEN 'error' THEN 2001 ELSE 3002 END AS class_uid, CAST(k // 20 + 1 AS INT) AS severity_id,
        count(*) AS events FROM ev GROUP BY 1, 2""",
)
def ocsf_counts(spark, sf):
    """Class and severity read from the VARIANT tail."""
    uid = F.expr(
        "CASE event_type WHEN 'view' THEN 4001 WHEN 'click' THEN 6003 WHEN 'error' THEN 2001 "
        "ELSE 3002 END"
    )
    body = F.struct(
        F.struct(uid.alias("class_uid"), F.floor(F.col("k") / 20 + 1).alias("severity_id")).alias(
            "securitylake"
        )
    )
    docs = events(spark, sf).select(F.to_variant_object(body).alias("aws"))
    fields = [
        F.try_variant_get("aws", f"$.securitylake.{n}", "int").alias(n)
        for n in ("class_uid", "severity_id")
    ]
    return C.ocsf_counts(docs.select(*fields))


@query(
    "security_root_and_iam",
    f"""WITH {CALLS} SELECT {bucket_sql(900)} AS bucket, count(*) FILTER (k < 10) AS root_calls,
        count(*) FILTER (action IN ('CreateAccessKey', 'AttachUserPolicy')) AS iam_calls FROM calls
        WHERE k < 10 OR action IN ('CreateAccessKey', 'AttachUserPolicy') GROUP BY 1""",
)
def root_and_iam(spark, sf):
    df = calls(spark, sf).withColumn(
        "identity_type", F.when(F.col("k") < 10, "Root").otherwise("IAMUser")
    )
    out = C.root_or_iam(df, ["CreateAccessKey", "AttachUserPolicy"])
    return out.withColumn("bucket", secs("bucket"))


@query(
    "security_exfiltration_evidence",
    f"""WITH {EV}, f AS (SELECT event_id AS finding_id, u, epoch_us(ts) AS us FROM ev WHERE event_type = 'error'),
        e AS (SELECT event_id AS evidence_id, u, epoch_us(ts) AS us,
          CASE event_type WHEN 'view' THEN 'data_event' ELSE 'flow' END AS kind,
          CASE event_type WHEN 'purchase' THEN v END AS bytes FROM ev WHERE event_type IN ('view', 'purchase')),
        p AS (SELECT finding_id, kind, evidence_id, e.us - f.us AS offset_us, bytes FROM f JOIN e ON e.u = f.u
          AND e.us BETWEEN f.us - {HALF_DAY * 1_000_000} AND f.us + {HALF_DAY * 1_000_000}),
        ok AS (SELECT finding_id FROM p GROUP BY 1 HAVING count(*) FILTER (kind = 'data_event') >= 1
          AND sum(bytes) > 10)
        SELECT finding_id, kind, evidence_id, offset_us, {r4_sql("bytes")} AS bytes FROM p
        WHERE finding_id IN (SELECT finding_id FROM ok)""",
)
def exfiltration_evidence(spark, sf):
    """The rows behind every finding, to the microsecond."""
    base = events(spark, sf).select(
        "event_type", "ts", F.concat(F.lit("ip-"), "u").alias("ip"), F.col("v").alias("bytes"),
        F.col("event_id").alias("finding_id"), F.col("event_id").alias("evidence_id"),
    )
    part = lambda kind: base.filter(F.col("event_type") == kind)
    out = C.exfiltration_evidence(
        part("error"), part("view"), part("purchase"), HALF_DAY, min_events=1, min_bytes=10
    )
    return out.select("finding_id", "kind", "evidence_id", "offset_us", r4(F.col("bytes")).alias("bytes"))

"""Security correlation: finding lineage, ordered chains, exfiltration, posture, OCSF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.operators.joins import expand_join, interval_join
from skyledger.session import stage

# The calls of a privilege escalation, in order.
ESCALATION_STEPS = ("ListUsers", "CreateAccessKey", "AttachUserPolicy", "AssumeRole")


def finding_lineage(detections: DataFrame, hub: DataFrame, lake: DataFrame) -> DataFrame:
    """Detection -> hub finding -> lake finding.

    ``detections(arn, ...)``, ``hub(hub_id, related_findings array<struct<id>>)`` and
    ``lake(finding_uid, ...)``. Findings without a follow-up stay in the result.
    """
    links = hub.select("hub_id", F.explode("related_findings").alias("_r")).select(
        "hub_id", F.col("_r.id").alias("arn")
    )
    promoted = expand_join(detections, links, ["arn"])
    return expand_join(promoted, lake.withColumnRenamed("finding_uid", "hub_id"), ["hub_id"])


def step_number(action: Column, steps=ESCALATION_STEPS) -> Column:
    """1-based position of a call in the chain, NULL for other calls."""
    names = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i + 1))])
    return F.try_element_at(names, action)


def known(keys: list[str]) -> Column:
    """Whether any part of a key is known; rows without one are not all the same unknown."""
    return F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()


def chain_counts(
    calls: DataFrame, actor: list[str], window: str = "1 hour", steps=ESCALATION_STEPS
) -> DataFrame:
    """C2, unordered: calls of every step per actor and tumbling window, all steps present."""
    counts = [F.count_if(F.col("action") == s).alias(f"n_{s}") for s in steps]
    present = F.lit(True)
    for s in steps:
        present &= F.col(f"n_{s}") > 0
    # Grouping by the window itself keeps its watermark, so the same plan runs on a stream.
    return (
        calls.filter(F.col("action").isin(*steps) & known(actor))
        .groupBy(*actor, F.window("ts", window).alias("_w"))
        .agg(*counts)
        .filter(present)
        .select(*actor, F.col("_w.start").alias("bucket"), *[f"n_{s}" for s in steps])
    )


def ordered_chains(
    calls: DataFrame, actor: list[str], window_seconds: int = 3600, steps=ESCALATION_STEPS
) -> DataFrame:
    """Every last step that ends an ordered chain within the window.

    Calls are ordered to the microsecond; calls of the very same time are taken in step order, since
    the steps of a chain may share their time. For every last step the result gives the latest
    possible chain start. Calls of which no part of the actor is known belong to nobody and are left
    out.

    * Calls of one (actor, step, time) collapse to one row before the shuffle.
    * A hot actor is cut into chunks of one window; rows are also handed to the next chunk, in
      which a chain that began before it may end. A chain lies in at most two chunks, so this
      is exact and no actor is one task.
    * The search keeps the latest start per step as running maxima: no pairs are built.
    """
    window = window_seconds * 1_000_000
    seen = (
        calls.withColumn("_step", step_number(F.col("action"), steps))
        .filter(F.col("_step").isNotNull() & known(actor))
        .groupBy(*actor, "_step", F.unix_micros("ts").alias("_at"))
        .agg(F.count("*").alias("calls"))
    )
    home = F.floor(F.col("_at") / window).cast("bigint")
    placed = seen.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.array(F.col("_home"), F.col("_home") + 1))
    )
    run = (
        Window.partitionBy(*actor, "_chunk")
        .orderBy("_at", "_step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    df = placed.withColumn("_l1", F.max(F.when(F.col("_step") == 1, F.col("_at"))).over(run))
    last = len(steps)
    for k in range(2, last):
        df = df.withColumn(
            f"_l{k}", F.max(F.when(F.col("_step") == k, F.col(f"_l{k - 1}"))).over(run)
        )
    begin = F.col(f"_l{last - 1}")
    return df.filter(
        (F.col("_step") == last)
        & (F.col("_chunk") == F.col("_home"))
        & (F.col("_at") - begin <= window)
    ).select(
        *actor,
        F.timestamp_micros(begin).alias("chain_start"),
        F.timestamp_micros("_at").alias("chain_end"),
        F.col("calls").alias("last_step_calls"),
    )


def exfiltration(
    findings: DataFrame,
    data_events: DataFrame,
    flows: DataFrame,
    window_seconds: int = 3600,
    min_events: int = 1,
    min_bytes: float = 0.0,
) -> DataFrame:
    """Findings with a burst of data events and large egress from the same address.

    Inputs have ``ip`` and ``ts``; flows also ``bytes``. The attacker is the source of findings
    and data events and the *destination* of the flow record; callers map ``ip`` accordingly.
    Everything within ``window_seconds`` on either side of a finding counts.

    The three tables are not joined pairwise. Each collapses to one row per (address, second);
    sums over a RANGE frame then give every finding its totals. A busy address is cut into time
    chunks, with its rows also handed to both neighbouring chunks. Rows without an address, which
    correlate with nothing, are left out.
    """

    def per_second(df: DataFrame, what: str, value: Column) -> DataFrame:
        zero = {"n_findings": F.lit(0), "n_events": F.lit(0), "egress": F.lit(0.0)}
        kinds = {"n_findings": "bigint", "n_events": "bigint", "egress": "double"}
        grouped = df.filter(known(["ip"])).groupBy("ip", F.unix_seconds("ts").alias("_sec")).agg(value.alias(what))
        return grouped.select(
            "ip", "_sec",
            *[(F.col(what) if n == what else z).cast(kinds[n]).alias(n) for n, z in zero.items()],
        )

    merged = (
        per_second(findings, "n_findings", F.count("*"))
        .unionByName(per_second(data_events, "n_events", F.count("*")))
        .unionByName(per_second(flows, "egress", F.sum("bytes").cast("double")))
        .groupBy("ip", "_sec")
        .agg(
            F.sum("n_findings").alias("n_findings"),
            F.sum("n_events").alias("n_events"),
            F.sum("egress").alias("egress"),
        )
    )
    home = F.floor(F.col("_sec") / window_seconds).cast("bigint")
    around = F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)
    placed = merged.withColumn("_home", home).withColumn("_chunk", F.explode(around))
    near = (
        Window.partitionBy("ip", "_chunk").orderBy("_sec").rangeBetween(-window_seconds, window_seconds)
    )
    return (
        placed.withColumns(
            {"data_events": F.sum("n_events").over(near), "egress_bytes": F.sum("egress").over(near)}
        )
        .filter((F.col("_chunk") == F.col("_home")) & (F.col("n_findings") > 0))
        .filter((F.col("data_events") >= min_events) & (F.col("egress_bytes") > min_bytes))
        .select(
            "ip", F.timestamp_seconds("_sec").alias("found_at"),
            F.col("n_findings").alias("findings"), "data_events", "egress_bytes",
        )
    )


def exfiltration_evidence(
    findings: DataFrame, data_events: DataFrame, flows: DataFrame, window_seconds: float = 3600,
    min_events: int = 1, min_bytes: float = 0.0,
) -> DataFrame:
    """C3 and J7 with the rows that prove it: every data event and flow of the address of a finding within
    ``window_seconds`` on either side of it, to the microsecond.

    ``findings(finding_id, ip, ts)``, ``data_events(evidence_id, ip, ts)``, ``flows(evidence_id, ip, ts,
    bytes)``. Columns: finding_id, ip, found_at, kind (data_event or flow), evidence_id, at, offset_us,
    bytes. Only findings with at least ``min_events`` data events and more than ``min_bytes`` bytes have
    evidence. A repeated finding is a finding a row.
    """
    none = F.lit(None).cast("double")
    evidence = data_events.select(
        "ip", F.col("ts").alias("at"), F.lit("data_event").alias("kind"), "evidence_id", none.alias("bytes")
    ).unionByName(
        flows.select(
            "ip", F.col("ts").alias("at"), F.lit("flow").alias("kind"), "evidence_id",
            F.col("bytes").cast("double").alias("bytes"),
        )
    )
    asked = stage(findings.select("finding_id", "ip", "ts").withColumn("_f", F.monotonically_increasing_id()), "findings")
    pairs = stage(
        interval_join(asked, evidence, ["ip"], window_seconds, window_seconds), "evidence"
    )
    enough = (
        pairs.groupBy("_f")
        .agg(F.count_if(F.col("kind") == "data_event").alias("_events"), F.sum("bytes").alias("_bytes"))
        .filter((F.col("_events") >= min_events) & (F.col("_bytes") > min_bytes))
        .select("_f")
    )
    return pairs.join(enough, "_f", "left_semi").select(
        "finding_id", "ip", F.col("ts").alias("found_at"), "kind", "evidence_id", "at",
        (F.unix_micros("at") - F.unix_micros("ts")).alias("offset_us"), "bytes",
    )


def tactics(docs: DataFrame) -> DataFrame:
    """C4: documents per tactic and technique."""
    return (
        docs.filter(F.col("threat.tactic.id").isNotNull())
        .groupBy(
            F.col("threat.tactic.id").alias("tactic_id"),
            F.col("threat.technique.id").alias("technique_id"),
        )
        .agg(F.count("*").alias("docs"))
    )


def posture(findings: DataFrame) -> DataFrame:
    """Pass rate per benchmark section (``section``, ``evaluation``)."""
    return findings.groupBy("section").agg(
        F.count("*").alias("checks"),
        F.avg((F.col("evaluation") == "passed").cast("double")).alias("pass_rate"),
    )


def ocsf_counts(events: DataFrame) -> DataFrame:
    """C6."""
    return events.groupBy("class_uid", "severity_id").agg(F.count("*").alias("events"))


def denied_by_source(flows: DataFrame) -> DataFrame:
    """Denied connections per source."""
    return flows.groupBy("srcaddr").agg(
        F.count_if(F.col("action") == "REJECT").alias("denied"), F.count("*").alias("flows")
    )


def egress_by_destination(flows: DataFrame) -> DataFrame:
    """Bytes sent per destination."""
    return flows.groupBy("dstaddr").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("flows"))


def domain_volume(queries: DataFrame, span: str = "15 minutes") -> DataFrame:
    """DNS queries per domain and bucket."""
    return (
        queries.groupBy(F.col("name").alias("domain"), F.window("ts", span).alias("_w"))
        .agg(F.count("*").alias("queries"))
        .select("domain", F.col("_w.start").alias("bucket"), "queries")
    )


def root_or_iam(calls: DataFrame, iam_actions: list[str]) -> DataFrame:
    """Calls by the root identity and calls that create identities, per bucket."""
    root = F.col("identity_type") == "Root"
    iam = F.col("action").isin(*iam_actions)
    return (
        calls.filter(root | iam)
        .groupBy(F.window("ts", "15 minutes").alias("_w"))
        .agg(F.count_if(root).alias("root_calls"), F.count_if(iam).alias("iam_calls"))
        .select(F.col("_w.start").alias("bucket"), "root_calls", "iam_calls")
    )

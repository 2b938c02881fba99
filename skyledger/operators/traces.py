"""Trace analytics over one table of transactions and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.functions.fields import promoted_name
from skyledger.operators.joins import lookup_join
from skyledger.operators.sequences import next_match, runs
from skyledger.operators.stats import FAILURE, bucket, stats_by
from skyledger.session import stage

ID = ["trace_id", "id"]
SERVICE_MAP_KEYS = ["caller", "callee"]


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("doc", path, kind)


def spans_table(docs: DataFrame) -> DataFrame:
    """Documents (VARIANT ``doc``) to the span layout; errors are left out."""
    tx = F.coalesce(_at("$.processor.event"), F.lit("")) == "transaction"
    labels = F.transform_values(
        _at("$.labels", "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "string")
    )
    either = lambda name, kind="string": F.coalesce(
        _at(f"$.span.{name}", kind), _at(f"$.transaction.{name}", kind)
    )
    return docs.filter(_at("$.processor.event").isin("transaction", "span")).select(
        _at("$['@timestamp']").try_cast("timestamp").alias("ts"),
        _at("$.trace.id").alias("trace_id"),
        F.coalesce(_at("$.span.id"), _at("$.transaction.id")).alias("id"),
        _at("$.parent.id").alias("parent_id"),
        _at("$.transaction.id").alias("transaction_id"),
        F.when(tx, "transaction").otherwise("span").alias("kind"),
        either("name").alias("name"),
        either("type").alias("type"),
        _at("$.span.subtype").alias("subtype"),
        _at("$.span.action").alias("action"),
        either("duration.us", "bigint").alias("duration_us"),
        _at("$.event.outcome").alias("outcome"),
        _at("$.service.name").alias("service_name"),
        _at("$.service.environment").alias("environment"),
        _at("$.service.language.name").alias("language"),
        _at("$.cloud.region").alias("region"),
        _at("$.cloud.account.id").alias("account_id"),
        _at("$.span.destination.service.resource").alias("destination"),
        _at("$.transaction.span_count.started", "int").alias("span_started"),
        _at("$.transaction.sampled", "boolean").alias("sampled"),
        F.coalesce(
            _at("$.faas.coldstart", "boolean"), _at("$.transaction.faas.coldstart", "boolean")
        ).alias("coldstart"),
        _at("$.telemetry.distro.name").alias("distro"),
        labels.alias("labels"),
    )


def errors_table(docs: DataFrame) -> DataFrame:
    """Error documents to the error layout."""
    frames = (
        "array<struct<type:string,message:string,handled:boolean,stacktrace:array<struct<"
        "`function`:string,filename:string,lineno:int,library_frame:boolean>>>>"
    )
    return docs.filter(_at("$.processor.event") == "error").select(
        _at("$['@timestamp']").try_cast("timestamp").alias("ts"),
        _at("$.error.id").alias("error_id"),
        _at("$.trace.id").alias("trace_id"),
        _at("$.transaction.id").alias("transaction_id"),
        _at("$.parent.id").alias("parent_id"),
        _at("$.service.name").alias("service_name"),
        _at("$.error.grouping_key").alias("grouping_key"),
        _at("$.error.culprit").alias("culprit"),
        _at("$.error.exception", frames).alias("exception"),
    )


def with_parent(spans: DataFrame, *columns: str) -> DataFrame:
    """Each span with columns of its parent; roots and orphans keep NULLs.

    A parent that was delivered more than once is one parent: the smallest value of each column.
    """
    parent = spans.groupBy("trace_id", F.col("id").alias("parent_id")).agg(
        *[F.min(c).alias(f"parent_{c}") for c in columns]
    )
    return spans.join(parent, ["trace_id", "parent_id"], "left")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent id resolves to nothing in their trace."""
    have = spans.select("trace_id", F.col("id").alias("parent_id"))
    return spans.filter(F.col("parent_id").isNotNull()).join(
        have, ["trace_id", "parent_id"], "left_anti"
    )


def validate(spans: DataFrame) -> DataFrame:
    """Per trace, number of documents, roots and unresolved parents, and the verdict.

    Every span adds one row for its own id and one for the id it refers to. One aggregation per
    (trace, id) then shows which ids are referred to but absent: one scan, no join, and a
    parent with very many children collapses before the shuffle.
    """
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def mention(key: Column, docs: Column, roots: Column, refs: Column) -> Column:
        return F.struct(
            key.alias("id"), docs.alias("docs"), roots.alias("roots"), refs.alias("refs")
        )

    root = F.when(F.col("parent_id").isNull(), one).otherwise(none)
    rows = spans.select(
        "trace_id",
        F.explode(
            F.array(
                mention(F.col("id"), one, root, none),
                mention(F.col("parent_id"), none, none, 1 - root),
            )
        ).alias("_m"),
    ).select("trace_id", "_m.*")
    per_id = rows.groupBy("trace_id", "id").agg(
        F.sum("docs").alias("docs"), F.sum("roots").alias("roots"), F.sum("refs").alias("refs")
    )
    out = per_id.groupBy("trace_id").agg(
        F.sum("docs").alias("docs"),
        F.sum("roots").alias("roots"),
        F.sum(F.when(F.col("docs") == 0, F.col("refs")).otherwise(none)).alias("orphans"),
    )
    valid = (F.col("docs") >= 2) & (F.col("roots") >= 1) & (F.col("orphans") == 0)
    return out.withColumn("valid", valid)


def depths(
    spans: DataFrame, keys: tuple[str, str, str] = ("trace_id", "id", "parent_id")
) -> DataFrame:
    """Depth of every span and the top of its branch, by pointer doubling.

    Every round each span jumps to the ancestor of its current ancestor, so a tree of depth d
    takes about log2(d) equi-joins of the id columns only. Each round is staged in the shared
    folder, which keeps the plan short and survives lost executors; spans that have arrived are not
    written again. One row per (trace, id): a span that was delivered more than once is one span.
    Spans whose parent is missing start their own branch. Of the spans below a root the nearest arrive
    in each round, so when a round brings none home, those left are in or below a parent cycle: they
    end with a NULL depth.
    """
    return _depths(_links(spans, keys))


def _links(spans: DataFrame, keys: tuple[str, str, str], *more: Column) -> DataFrame:
    """One row per (trace_id, id) with its parent as ``up``; of copies the smallest parent counts."""
    trace, own, up = keys
    return spans.groupBy(F.col(trace).alias("trace_id"), F.col(own).alias("id")).agg(F.min(up).alias("up"), *more)


def _depths(links: DataFrame) -> DataFrame:
    """``depths`` of rows that are one per (trace_id, id); those without a parent are home at once and take
    part in no join but as parents."""
    zero = F.lit(0).cast("bigint")
    tops = links.filter(F.col("up").isNull()).select(
        "trace_id", "id", "up", zero.alias("depth"), F.col("id").alias("top")
    )
    known = links.select("trace_id", F.col("id").alias("up"), F.lit(True).alias("_known"))
    below = links.filter(F.col("up").isNotNull()).select("trace_id", "id", "up")
    state = below.join(known, ["trace_id", "up"], "left").select(
        "trace_id", "id",
        F.when(F.col("_known"), F.col("up")).alias("up"),
        F.when(F.col("_known"), F.lit(1)).otherwise(0).cast("bigint").alias("depth"),
        F.when(F.col("_known"), F.col("up")).otherwise(F.col("id")).alias("top"),
    ).unionByName(tops)
    state = stage(state, "depth")
    home, away = state.filter(F.col("up").isNull()), state.filter(F.col("up").isNotNull())
    left = away.count()
    while left:
        step = home.unionByName(away).select(
            "trace_id", F.col("id").alias("up"), F.col("up").alias("_up"),
            F.col("depth").alias("_depth"), F.col("top").alias("_top"),
        )
        moved = stage(
            away.join(step, ["trace_id", "up"]).select(
                "trace_id", "id", F.col("_up").alias("up"),
                (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("top"),
            ),
            "depth",
        )
        home = home.unionByName(moved.filter(F.col("up").isNull()))
        away = moved.filter(F.col("up").isNotNull())
        before, left = left, away.count()
        if left == before:
            break
    lost = away.select(
        "trace_id", "id", F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("top")
    )
    return home.select("trace_id", "id", "depth", "top").unionByName(lost)


def paths(
    spans: DataFrame, keys: tuple[str, str, str] = ("trace_id", "id", "parent_id"), label: str = "id"
) -> DataFrame:
    """trace_id, id, depth, top and ``path``: the ``label`` of every span from the top of its branch
    down to itself, with the ids themselves in ``ids``.

    Pointer doubling as in ``depths``, but every span carries the list of its ancestors so far: a round
    puts the list of the current ancestor in front, so lists double and a tree of depth d takes log2(d)
    equi-joins, whatever part of the spans one trace or one parent has. A span that was delivered more
    than once is one span (smallest parent and label). Spans without a parent, or whose parent is missing,
    start a path. Spans in or below a parent cycle get NULL in all but the ids: they are told by
    ``depths``, so that no list is ever built for them.
    """
    return _paths(stage(_links(spans, keys, F.min(label).alias("label")), "links", compression="zstd"))


def _paths(links: DataFrame) -> DataFrame:
    """``paths`` of staged rows that are one per (trace_id, id), with ``up`` and ``label``. Where no row has
    a parent, all are tops and nothing is joined."""
    links = links.withColumn("steps", F.array(F.struct("id", "label")))
    if links.filter(F.col("up").isNotNull()).isEmpty():
        return links.select(
            "trace_id", "id", F.lit(0).cast("bigint").alias("depth"), F.col("id").alias("top"),
            F.col("steps.label").alias("path"), F.col("steps.id").alias("ids"),
        )
    deep = stage(_depths(links), "path-depth")
    placed = links.join(deep, ["trace_id", "id"])
    tops = F.col("depth") == 0
    state = stage(
        placed.filter(F.col("depth").isNotNull())
        .withColumn("up", F.when(tops, F.lit(None)).otherwise(F.col("up")))
        .select("trace_id", "id", "depth", "top", "up", "steps"),
        "path",
    )
    home, away = state.filter(F.col("up").isNull()), state.filter(F.col("up").isNotNull())
    while not away.isEmpty():
        ahead = home.unionByName(away).select(
            "trace_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps")
        )
        moved = stage(
            away.join(ahead, ["trace_id", "up"]).select(
                "trace_id", "id", "depth", "top", F.col("_up").alias("up"),
                F.concat("_steps", "steps").alias("steps"),
            ),
            "path",
        )
        home = home.unionByName(moved.filter(F.col("up").isNull()))
        away = moved.filter(F.col("up").isNotNull())
    found = home.select(
        "trace_id", "id", "depth", "top", F.col("steps.label").alias("path"), F.col("steps.id").alias("ids")
    )
    lost = deep.filter(F.col("depth").isNull()).select(
        "trace_id", "id", "depth", "top", F.lit(None).cast(found.schema["path"].dataType).alias("path"),
        F.lit(None).cast(found.schema["ids"].dataType).alias("ids"),
    )
    return found.unionByName(lost)


def path_profile(spans: DataFrame, label: str = "name") -> DataFrame:
    """Per path of labels (the call tree of all traces laid over each other) the number of
    spans, of traces, their total duration and the time that is not spent in children.

    A path without spans of its own doesn't occur; spans in a parent cycle have no path. Lists of labels are
    built for parents only: a span without children takes its parent's and adds its own label, and one
    without a parent needs nobody else's.
    """
    nodes = _call_nodes(spans, label)
    parents = nodes.filter("is_parent").select("trace_id", "id", "up", "label")
    found = _paths(parents).select("trace_id", F.col("id").alias("at"), "path", F.lit(True).alias("_known"))
    mine = F.array("label")
    measured = ["trace_id", "path", "spans", "total_us", "self_us"]
    tops = nodes.filter(F.col("up").isNull()).withColumn("path", mine).select(measured)
    below = (
        nodes.filter(F.col("up").isNotNull())
        .withColumn("at", F.when(F.col("is_parent"), F.col("id")).otherwise(F.col("up")))
        .join(found, ["trace_id", "at"], "left")
        .withColumn(
            "path",
            F.when(F.col("is_parent"), F.col("path"))
            .when(F.col("_known"), F.concat("path", mine))
            .otherwise(mine),
        )
        .filter(F.col("path").isNotNull())
        .select(measured)
    )
    return (
        tops.unionByName(below)
        .groupBy("path")
        .agg(
            F.sum("spans").alias("spans"), F.count_distinct("trace_id").alias("traces"),
            F.sum("total_us").alias("total_us"), F.sum("self_us").alias("self_us"),
        )
    )


def _call_nodes(spans: DataFrame, label: str) -> DataFrame:
    """One staged row per (trace_id, id): parent, label, whether a span names it as its parent, the number of
    copies, their durations and what their children leave of them."""
    thin = spans.select("trace_id", "id", F.col("parent_id").alias("up"), F.col(label).alias("label"), "duration_us")
    children = (
        thin.filter(F.col("up").isNotNull())
        .groupBy("trace_id", F.col("up").alias("id"))
        .agg(F.sum("duration_us").alias("child_us"), F.lit(True).alias("_named"))
    )
    zero = F.lit(0).cast("bigint")
    own_us = F.greatest(F.col("duration_us") - F.coalesce("child_us", zero), zero)
    nodes = (
        thin.filter(F.col("trace_id").isNotNull() & F.col("id").isNotNull())
        .join(children, ID, "left")
        .groupBy(ID)
        .agg(
            F.min("up").alias("up"), F.min("label").alias("label"), F.max("_named").isNotNull().alias("is_parent"),
            F.count("*").alias("spans"), F.sum("duration_us").alias("total_us"), F.sum(own_us).alias("self_us"),
        )
    )
    return stage(nodes, "call-nodes", compression="zstd")


def service_map(spans: DataFrame) -> DataFrame:
    """T4: caller to callee edges with calls, error rate and average duration.

    Edges come from a child in another service and from a span's destination. Siblings with the
    same service collapse before the join with their parent, and a parent that was delivered more
    than once is one caller.
    """
    failed = F.count_if(F.col("outcome") == FAILURE)
    calls = (
        spans.filter(F.col("parent_id").isNotNull())
        .groupBy("trace_id", "parent_id", F.col("service_name").alias("callee"))
        .agg(
            F.count("*").alias("calls"),
            failed.alias("errors"),
            F.sum("duration_us").alias("us"),
        )
    )
    parents = spans.groupBy("trace_id", F.col("id").alias("parent_id")).agg(
        F.min("service_name").alias("caller")
    )
    inner = (
        calls.join(parents, ["trace_id", "parent_id"])
        .filter(F.col("caller") != F.col("callee"))
        .select(*SERVICE_MAP_KEYS, "calls", "errors", "us")
    )
    outer = (
        spans.filter(F.col("destination").isNotNull())
        .groupBy(F.col("service_name").alias("caller"), F.col("destination").alias("callee"))
        .agg(
            F.count("*").alias("calls"),
            failed.alias("errors"),
            F.sum("duration_us").alias("us"),
        )
    )
    return (
        inner.unionByName(outer)
        .groupBy(*SERVICE_MAP_KEYS)
        .agg(
            F.sum("calls").alias("calls"),
            (F.sum("errors") / F.sum("calls")).alias("error_rate"),
            (F.sum("us") / F.sum("calls")).alias("avg_us"),
        )
    )


def dependencies(spans: DataFrame) -> DataFrame:
    """T5."""
    return (
        spans.filter(F.col("destination").isNotNull())
        .groupBy("service_name", "destination")
        .agg(F.count("*").alias("calls"), F.avg("duration_us").alias("avg_us"))
    )


def transaction_stats(spans: DataFrame, service: str | None = None) -> DataFrame:
    """Count and average duration per transaction name, most frequent first."""
    df = spans.filter(F.col("kind") == "transaction")
    if service:
        df = df.filter(F.col("service_name") == service)
    return stats_by(df, ["name"], F.col("duration_us"))


def span_stats(spans: DataFrame) -> DataFrame:
    """The same per span type and subtype."""
    return stats_by(
        spans.filter(F.col("kind") == "span"), ["type", "subtype"], F.col("duration_us")
    )


def self_time(spans: DataFrame) -> DataFrame:
    """Duration minus the sum of the children's durations, not below zero."""
    children = (
        spans.filter(F.col("parent_id").isNotNull())
        .groupBy("trace_id", F.col("parent_id").alias("id"))
        .agg(F.sum("duration_us").alias("child_us"))
    )
    used = F.coalesce("child_us", F.lit(0).cast("bigint"))
    return (
        spans.join(children, ID, "left")
        .withColumn("child_us", used)
        .withColumn(
            "self_us", F.greatest(F.col("duration_us") - F.col("child_us"), F.lit(0).cast("bigint"))
        )
    )


def span_count_check(spans: DataFrame) -> DataFrame:
    """Spans a transaction says it started against the spans that arrived."""
    seen = (
        spans.filter(F.col("kind") == "span")
        .groupBy("trace_id", F.col("transaction_id").alias("id"))
        .agg(F.count("*").alias("observed"))
    )
    return (
        spans.filter(F.col("kind") == "transaction")
        .select("trace_id", "id", "span_started")
        .join(seen, ID, "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0).cast("bigint")))
        .withColumn("missing", F.col("span_started") - F.col("observed"))
    )


def service_health(spans: DataFrame, span: str = "15 minutes") -> DataFrame:
    """Throughput, error rate and latency per service and bucket."""
    return (
        spans.filter(F.col("kind") == "transaction")
        .groupBy("service_name", bucket(F.col("ts"), span).alias("bucket"))
        .agg(
            F.count("*").alias("requests"),
            F.avg((F.col("outcome") == FAILURE).cast("double")).alias("error_rate"),
            F.avg("duration_us").alias("avg_us"),
        )
    )


def cold_start_rate(spans: DataFrame) -> DataFrame:
    """Share of cold starts per function."""
    return (
        spans.filter((F.col("kind") == "transaction") & F.col("coldstart").isNotNull())
        .groupBy("service_name")
        .agg(F.count("*").alias("invocations"), F.avg(F.col("coldstart").cast("int")).alias("rate"))
    )


def error_groups(errors: DataFrame) -> DataFrame:
    """Errors by service, exception type and culprit, with a top application frame.

    The grouping key of the documents is random, so it is not used.
    """
    one = errors.select("service_name", "culprit", "ts", F.explode("exception").alias("e"))
    own = F.filter("e.stacktrace", lambda f: ~F.coalesce(f["library_frame"], F.lit(False)))
    frame = F.get(own, F.lit(0))
    return (
        one.withColumn("frame", F.concat_ws(":", frame["filename"], frame["function"]))
        .groupBy("service_name", F.col("e.type").alias("exception_type"), "culprit")
        .agg(
            F.count("*").alias("errors"),
            F.count_if(~F.col("e.handled")).alias("unhandled"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.min("frame").alias("top_frame"),
        )
    )


def error_context(errors: DataFrame, spans: DataFrame) -> DataFrame:
    """Errors with the transaction or span they happened in."""
    where = spans.select(
        "trace_id", F.col("id").alias("parent_id"), F.col("name").alias("at_name"),
        F.col("kind").alias("at_kind"), F.col("duration_us").alias("at_us"),
    )
    return lookup_join(errors, where, ["trace_id", "parent_id"])


def linked_traces(spans: DataFrame) -> DataFrame:
    """Consumer traces with the producer trace they name; upstream may be absent."""
    links = spans.select(
        "trace_id", "service_name",
        F.try_element_at("labels", F.lit("parent_trace_id")).alias("upstream"),
    ).filter(F.col("upstream").isNotNull()).distinct()
    upstream = (
        spans.filter(F.col("parent_id").isNull())
        .groupBy(F.col("trace_id").alias("upstream"))
        .agg(F.min("service_name").alias("upstream_service"), F.min("ts").alias("upstream_ts"))
    )
    return lookup_join(links, upstream, ["upstream"])


def by_label(spans: DataFrame, other: DataFrame, label: str, key: str) -> DataFrame:
    """Spans joined to another table by a value kept in the label map."""
    keyed = spans.withColumn(key, F.try_element_at("labels", F.lit(label)))
    return keyed.filter(F.col(key).isNotNull()).join(other, key)


def repeated_spans(spans: DataFrame, queue_subtype: str = "sqs") -> DataFrame:
    """Span names repeated within a trace that also reaches a queue (retry, dead letter)."""
    repeats = (
        spans.filter(F.col("kind") == "span")
        .groupBy("trace_id", "name")
        .agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == FAILURE).alias("failed"))
        .filter(F.col("attempts") > 1)
    )
    queued = spans.filter(F.col("subtype") == queue_subtype).select("trace_id").distinct()
    return repeats.join(queued, "trace_id", "left_semi")


def retry_chains(
    spans: DataFrame, queue_subtype: str = "sqs", attempts: int = 2, chunk_seconds: int = 3600
) -> DataFrame:
    """T13 in order: spans of one name that fail at least ``attempts`` times in a row, then a queue span.

    Columns: trace_id, name, attempts, first_at, last_at, queued_at, recovered_at (the next span of the
    name, if it comes after the queue and succeeds). A success between two failures, or a queue span,
    ends a row of failures; a queue before the failures doesn't count. Order is (ts, id), spans without a
    time or name are left out.

    Every span of the trace would have to meet every queue span; instead each takes the first queue
    span behind it along, and of those a name's sequence needs no others. A trace or name that holds a
    large part of all spans is cut into time chunks (``operators.sequences``).
    """
    queued = F.coalesce(F.col("subtype") == queue_subtype, F.lit(False))
    rows = stage(
        spans.filter((F.col("kind") == "span") & F.col("name").isNotNull() & F.col("trace_id").isNotNull())
        .select(
            "trace_id", "name", "ts", "id", queued.alias("queue"),
            F.when(F.col("outcome") == FAILURE, "F").otherwise("S").alias("symbol"),
        ),
        "attempts",
    )
    tried = next_match(rows, ["trace_id"], "queue", "_queue", chunk_seconds=chunk_seconds).filter("NOT queue")
    marks = tried.filter(F.col("_queue").isNotNull()).select(
        "trace_id", "name", F.timestamp_micros("_queue._at").alias("ts"), F.col("_queue.id").alias("id"),
        F.lit("Q").alias("symbol"),
    ).distinct()
    row = tried.select("trace_id", "name", "ts", "id", "symbol").unionByName(marks)
    found = stage(runs(row, ["trace_id", "name"], chunk_seconds=chunk_seconds), "retry-runs")
    chains = found.filter((F.col("symbol") == "F") & (F.col("rows") >= attempts) & (F.col("next_symbol") == "Q"))
    after = found.filter((F.col("symbol") == "Q") & (F.col("next_symbol") == "S")).select(
        "trace_id", "name", F.col("begin_at").alias("next_at"), F.col("begin_id").alias("next_id"),
        F.col("next_at").alias("recovered_at"),
    )
    return chains.join(after, ["trace_id", "name", "next_at", "next_id"], "left").select(
        "trace_id", "name", F.col("rows").alias("attempts"), F.col("begin_at").alias("first_at"),
        F.col("end_at").alias("last_at"), F.col("next_at").alias("queued_at"), "recovered_at",
    )


def fan_out(spans: DataFrame) -> DataFrame:
    """Number of children per parent span."""
    return (
        spans.filter(F.col("parent_id").isNotNull())
        .groupBy("trace_id", "parent_id")
        .agg(F.count("*").alias("width"))
    )


def token_usage(spans: DataFrame) -> DataFrame:
    """Input and output tokens per model, from text labels."""
    label = lambda k: F.try_element_at("labels", F.lit(k))
    return (
        spans.filter(label("gen_ai_request_model").isNotNull())
        .groupBy(label("gen_ai_request_model").alias("model"))
        .agg(
            F.count("*").alias("calls"),
            F.sum(label("gen_ai_usage_input_tokens").try_cast("bigint")).alias("input_tokens"),
            F.sum(label("gen_ai_usage_output_tokens").try_cast("bigint")).alias("output_tokens"),
        )
    )


def stage_durations(spans: DataFrame, subtype: str = "spark", span: str = "15 minutes") -> DataFrame:
    """Stage durations per service and bucket, ready for a mean detector."""
    return (
        spans.filter(F.col("subtype") == subtype)
        .groupBy("service_name", bucket(F.col("ts"), span).alias("bucket"))
        .agg(F.count("*").alias("stages"), F.avg("duration_us").alias("avg_us"))
    )


def detector_documents(spans: DataFrame) -> DataFrame:
    """Spans under the field names that the trace detectors read."""
    tx = F.col("kind") == "transaction"
    names = {
        "processor.event": F.col("kind"),
        "service.name": F.col("service_name"),
        "event.outcome": F.col("outcome"),
        "transaction.duration.us": F.when(tx, F.col("duration_us")),
        "span.duration.us": F.when(~tx, F.col("duration_us")),
        "span.type": F.when(~tx, F.col("type")),
        "span.subtype": F.col("subtype"),
        "faas.coldstart": F.col("coldstart") if "coldstart" in spans.columns else F.lit(None),
    }
    fields = [c.alias(promoted_name(n)) for n, c in names.items()]
    return spans.select("ts", F.lit("apm").alias("dataset"), F.lit("traces").alias("signal"), *fields)


def sample_traces(spans: DataFrame, ratio: float = 0.1, key: str = "trace_id") -> DataFrame:
    """Keep whole traces, chosen by a digest of the trace id that any engine can compute."""
    place = F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("bigint")
    return spans.filter(place < int(ratio * (1 << 32)))


def sibling_gaps(spans: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Time between the end of the previous sibling and the start of a span, in µs.

    Siblings are ordered by (start, id). A parent may have a large part of all spans, so siblings are
    compared within time chunks. Only the first and last span of a chunk are then lined up by parent:
    the first takes the end of the last one of the chunk before it. Both steps read the same shuffled
    rows. Spans without a time stay, with a NULL gap.
    """
    start = F.unix_micros("ts")
    parent = ["trace_id", "parent_id"]
    df = (
        spans.filter(F.col("parent_id").isNotNull())
        .withColumn("_start", start)
        .withColumn("_end", start + F.col("duration_us"))
        .withColumn("_chunk", F.floor(F.col("_start") / (chunk_seconds * 1_000_000)).cast("bigint"))
    )
    near = Window.partitionBy(*parent, "_chunk").orderBy("_start", "id")
    df = df.withColumns(
        {
            "_prev": F.lag("_end").over(near),
            "_rank": F.row_number().over(near),
            "_last": F.lead(F.lit(1)).over(near).isNull(),
        }
    )
    edge = (F.col("_rank") == 1) | F.col("_last")
    along = Window.partitionBy(*parent).orderBy("_chunk", "_start", "id")
    carried = F.when(F.col("_rank") == 1, F.lag("_end").over(along)).otherwise(F.col("_prev"))
    edges = df.filter(edge).withColumn("_prev", carried)
    out = df.filter(~edge).unionByName(edges)
    return out.withColumn("gap_us", F.col("_start") - F.col("_prev")).select(*spans.columns, "gap_us")

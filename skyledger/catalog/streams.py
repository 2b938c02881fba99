"""Z*: Structured Streaming runs over the event table, read back as tables.

Each plan starts a stream with an available-now trigger and a checkpoint in the shared folder.
The comparison SQL gives the batch result restricted to what the watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, events, query, r4, r4_sql, secs, secs_sql
from skyledger.catalog.detection import SPANNED, scores_over, shaped
from skyledger.catalog.parsing import LINE_SPARK, LINES
from skyledger.operators import detect as D
from skyledger.operators import parse, route
from skyledger.plans import parsers
from skyledger.session import configure, scratch_path
from skyledger.streaming import flows as Z

# The watermark has millisecond steps and lies one delay behind the newest event.
MARK = "(SELECT (epoch_us(max(ts)) // 1000 - {ms}) * 1000 FROM events)"
MINUTE_MARK = MARK.format(ms=60_000)


def event_stream(spark, sf):
    configure(spark)
    layout = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"),
        "event_type", F.col("value").alias("v"), k.alias("k"), "props",
    )


JOBS = [
    D.Job("stream", "errors-by-user", "error", "high_count", split=("user",)),
    D.Job("stream", "value-by-type", "view", "high_mean", "value"),
    D.Job("stream", "purchases", "purchase", "count"),
    D.Job("stream", "rare-levels", "click", "rare", split=("level",)),
    # Data once in a while: its history reaches back over many silent buckets.
    D.Job("stream", "sparse-peaks", "sparse", "high_max", "value"),
]


def documents(df):
    sparse = (F.col("event_type") == "signup") & (F.col("k") < 30)
    return df.select(
        "ts", F.when(sparse, "sparse").otherwise(F.col("event_type")).alias("dataset"),
        F.col("u").cast("string").alias("user"), F.col("v").alias("value"),
        F.concat(F.lit("a|"), F.when(F.col("k") >= 10, F.floor(F.col("k") / 10))).alias("level"),
    )


FEED = """SELECT 'stream/errors-by-user' AS job, 'high_count' AS fn, CAST(u AS VARCHAR) AS entity, ts,
    CAST(NULL AS DOUBLE) AS m FROM ev WHERE event_type = 'error'
  UNION ALL SELECT 'stream/value-by-type', 'high_mean', '', ts, v FROM ev WHERE event_type = 'view'
  UNION ALL SELECT 'stream/purchases', 'count', '', ts, NULL FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT 'stream/rare-levels', 'rare', CASE WHEN k >= 10 THEN 'a\\|' || k // 10 ELSE '\\N' END,
    ts, NULL FROM ev WHERE event_type = 'click'
  UNION ALL SELECT 'stream/sparse-peaks', 'high_max', '', ts, v FROM ev
    WHERE event_type = 'signup' AND k < 30"""


def closed_sql(seconds: int, newest: str = "feed") -> str:
    """Buckets that the watermark has passed at the end of the stream."""
    return (
        f"({bucket_sql(seconds)} + {seconds}) * 1000000 <= "
        f"(SELECT (epoch_us(max(ts)) // 1000 - 60000) * 1000 FROM {newest})"
    )


CLOSED = closed_sql(900)


@query(
    "stream_buckets",
    f"""WITH {EV}, feed AS ({FEED}) SELECT job, entity, {bucket_sql(900)} AS bucket, count(*) AS docs,
        {r4_sql("sum(m)")} AS total FROM feed GROUP BY 1, 2, 3 HAVING {CLOSED}""",
)
def buckets(spark, sf):
    """Closed buckets only."""
    out = Z.run_to_table(Z.bucket_stream(documents(event_stream(spark, sf)), JOBS), "buckets")
    return out.select(
        "job", "entity", secs("bucket").alias("bucket"), "docs", r4(F.col("total")).alias("total")
    )


@query(
    "stream_late_split",
    f"""WITH {EV} SELECT CASE WHEN k <= 40 THEN 'in_time' ELSE 'late' END AS verdict, count(*) AS n,
        CAST(sum(u) AS BIGINT) AS users FROM ev GROUP BY 1""",
)
def late_split(spark, sf):
    """Z3: documents that arrive k * 3 minutes after their time."""
    root = scratch_path(spark, "late")
    arrival = F.col("ts") + F.make_interval(mins=F.col("k") * 3)
    Z.write_split(
        event_stream(spark, sf), arrival, f"{root}/good", f"{root}/late", f"{root}/state"
    ).awaitTermination()
    good = spark.read.parquet(f"{root}/good").select(F.lit("in_time").alias("verdict"), "u")
    late = spark.read.parquet(f"{root}/late").select(F.lit("late").alias("verdict"), "u")
    return good.unionByName(late).groupBy("verdict").agg(
        F.count("*").alias("n"), F.sum("u").alias("users")
    )


@query(
    "stream_create_only",
    f"WITH {EV} SELECT DISTINCT u, event_type, {bucket_sql(60)} AS minute FROM ev",
)
def create_only(spark, sf):
    """One row per user, type and minute."""
    minute = F.date_trunc("minute", F.col("ts"))
    df = event_stream(spark, sf).select("u", "event_type", minute.alias("ts"))
    out = Z.run_to_table(Z.create_only(df, ["u", "event_type", "ts"]), "create-only")
    return out.select("u", "event_type", secs("ts").alias("minute"))


@query(
    "stream_detector_scores",
    f"""WITH {scores_over(FEED, CLOSED)} SELECT job, entity, b, function, {r4_sql("actual")} AS actual,
        {r4_sql("score")} AS score, seen FROM scores""",
)
def detector_scores(spark, sf):
    """Scores kept up across micro-batches; the comparison scores all closed buckets at once."""
    root = scratch_path(spark, "detector")
    detector = Z.Detector(JOBS, root)
    stream = Z.bucket_stream(documents(event_stream(spark, sf)), JOBS)
    detector.start(stream, f"{root}/state").awaitTermination()
    return shaped(detector.scores(spark))


@query(
    "stream_backfill_resumed",
    f"""WITH {scores_over(FEED, CLOSED)} SELECT job, entity, b, function, {r4_sql("actual")} AS actual,
        {r4_sql("score")} AS score, seen FROM scores""",
)
def backfill_resumed(spark, sf):
    """The first half in one batch, the rest as a stream that goes on from its snapshot; the
    comparison scores everything at once."""
    span = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    middle = (F.unix_seconds(F.col("a").cast("timestamp")) + F.unix_seconds(F.col("b").cast("timestamp"))) / 2
    until = span.select(F.timestamp_seconds(F.floor(middle / 3600) * 3600)).first()[0]
    root = scratch_path(spark, "resumed")
    Z.Detector(JOBS, root).backfill(documents(events(spark, sf)), until)
    detector = Z.Detector(JOBS, root, resume=True)
    rest = documents(event_stream(spark, sf)).filter(F.col("ts") >= F.lit(until))
    detector.start(Z.bucket_stream(rest, JOBS), f"{root}/state").awaitTermination()
    return shaped(detector.scores(spark))


def spanned_closed_sql(job: D.Job) -> str:
    seconds = D.span_seconds(job.span)
    feed = f"SELECT '{job.key}' AS job, '{job.function}' AS fn, event_type AS entity, ts, v AS m FROM ev"
    return (
        f"SELECT * FROM (WITH {scores_over(feed, closed_sql(seconds), seconds)} SELECT job, entity, b, "
        f"function, {r4_sql('actual')} AS actual, {r4_sql('score')} AS score, seen FROM scores)"
    )


@query("stream_spans_per_job", " UNION ALL ".join(spanned_closed_sql(j) for j in SPANNED))
def spans_per_job(spark, sf):
    """Jobs of 15 and 60 minutes in one stream, each with buckets of its own span."""
    docs = event_stream(spark, sf).select(
        "ts", F.lit("all").alias("dataset"), F.col("event_type").alias("kind"), F.col("v").alias("value")
    )
    root = scratch_path(spark, "spans")
    detector = Z.Detector(SPANNED, root)
    detector.start(Z.bucket_stream(docs, SPANNED), f"{root}/state").awaitTermination()
    return shaped(detector.scores(spark))


@query(
    "stream_parse_and_route",
    f"""WITH {LINES} SELECT 'logs-aws.lambda_logs-default' AS index, event_type = 'click' AS parsed,
        count(*) AS n FROM lines GROUP BY 2""",
)
def parse_and_route(spark, sf):
    """Parse and route statelessly, one folder per index."""
    df = event_stream(spark, sf).select(
        "event_id", F.expr(LINE_SPARK).alias("message"), F.lit("aws.lambda_logs").alias("dataset")
    )
    out = parse.parse_documents(df, parsers.parsers_of(["serverless"]))
    routed = out.select(
        "event_id", F.col("parsed").isNotNull().alias("parsed"),
        route.index_name(F.lit("logs-aws"), F.col("dataset")).alias("index"),
    )
    stored = Z.run_to_table(routed, "routed", ["index"])
    return stored.groupBy("index", "parsed").agg(F.count("*").alias("n"))


@query(
    "stream_finding_join",
    f"""WITH {EV} SELECT a.event_id, b.event_type AS other FROM ev a JOIN ev b
        ON a.event_id = b.event_id AND a.event_id % 5 <> 0 AND b.event_id % 3 <> 0""",
)
def finding_join(spark, sf):
    """Two streams of findings meet by finding id within an hour."""
    named = lambda n: F.when(F.col("event_id") % n != 0, F.col("event_id")).alias("event_id")
    # every event is in both streams; some have no finding id on one side and meet nothing
    left = event_stream(spark, sf).select(named(5), "ts")
    right = event_stream(spark, sf).select(
        named(3), F.col("ts").alias("other_ts"), F.col("event_type").alias("other")
    )
    joined = Z.finding_stream(
        left.withWatermark("ts", "1 hour"), right.withWatermark("other_ts", "1 hour"), "event_id"
    )
    return Z.run_to_table(joined.select("event_id", "other"), "findings")


@query(
    "stream_chain_counts",
    f"""WITH {EV} SELECT u, {bucket_sql(86400)} AS bucket, count(*) FILTER (event_type = 'view') AS n1,
        count(*) FILTER (event_type = 'click') AS n2, count(*) FILTER (event_type = 'signup') AS n3,
        count(*) FILTER (event_type = 'purchase') AS n4 FROM ev WHERE event_type <> 'error'
        GROUP BY 1, 2 HAVING n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0
          AND ({bucket_sql(86400)} + 86400) * 1000000 <= {MINUTE_MARK}""",
)
def chain_counts(spark, sf):
    """Escalation chains per actor and closed day."""
    action = F.expr(
        "CASE event_type WHEN 'view' THEN 'ListUsers' WHEN 'click' THEN 'CreateAccessKey' "
        "WHEN 'signup' THEN 'AttachUserPolicy' WHEN 'purchase' THEN 'AssumeRole' END"
    )
    df = event_stream(spark, sf).select("ts", "u", action.alias("action"))
    out = Z.run_to_table(Z.chain_stream(df, ["u"], "1 day"), "chains")
    names = ["n_ListUsers", "n_CreateAccessKey", "n_AttachUserPolicy", "n_AssumeRole"]
    return out.select(
        "u", secs("bucket").alias("bucket"),
        *[F.col(c).alias(f"n{i + 1}") for i, c in enumerate(names)],
    )


@query(
    "stream_invocations",
    f"""WITH {LINES}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 7200000000
          THEN 0 ELSE 1 END AS fresh FROM lines WINDOW w AS (PARTITION BY u ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY u ORDER BY ts) AS no FROM g)
        SELECT 'r-' || u AS request_id, {secs_sql("min(ts)")} AS opened,
          count(*) FILTER (event_type IN ('click', 'error')) AS app_lines,
          count(*) FILTER (event_type = 'purchase') AS reports FROM s GROUP BY u, no
        HAVING epoch_us(max(ts)) + 7200000000 <= {MINUTE_MARK}""",
)
def invocations(spark, sf):
    """Requests that were silent for two hours, as closed sessions."""
    df = event_stream(spark, sf).select("ts", F.expr(LINE_SPARK).alias("message"))
    out = Z.run_to_table(Z.invocation_stream(df, "2 hours"), "invocations")
    return out.select("request_id", secs("opened").alias("opened"), "app_lines", "reports")

"""D*: the detector jobs over events, one query per job group.

Every event yields one document per dataset of the group. Which conditions a document meets
follows from ``k``, split fields from the user and measures from the value; ``_assignments``
lays that out once, and the comparison SQL reads the same layout as plain predicates.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from skyledger.catalog.base import EV, bucket_sql, documents, events, query, r4, r4_sql, secs
from skyledger.operators import detect as D
from skyledger.plans import jobs as J

SPAN, SECONDS = "15 minutes", 900
STEP = 30


class Layout:
    """Field values per dataset of a job group, as SQL snippets over u, k, v."""

    def __init__(self, jobs: list[D.Job]):
        self.jobs = jobs
        self.datasets = sorted({j.dataset for j in jobs})
        self.tested: dict[tuple[str, str], list[tuple]] = {}
        for j in jobs:
            for name, op, value in j.where:
                seen = self.tested.setdefault((j.dataset, name), [])
                if (op, value) not in seen:
                    seen.append((op, value))
        self.values: dict[tuple[str, str], str] = {}
        for (dataset, name), tests in self.tested.items():
            numeric = any(op == "ge" for op, _ in tests)
            self.values[dataset, name] = self._tested_value(tests, numeric)
        for j in jobs:
            for i, name in enumerate(j.split):
                self.values.setdefault((j.dataset, name), "event_type" if i else "concat('u', u)")
            if j.field:
                self.values.setdefault((j.dataset, j.field), "v")
            self.values.setdefault((j.dataset, "cloud.region"), "event_type")
            self.values.setdefault((j.dataset, "cloud.account.id"), "concat('u', u)")

    @staticmethod
    def _tested_value(tests, numeric: bool) -> str:
        whens = []
        for i, (op, value) in enumerate(tests):
            literal = value[0] if op == "in" else value
            literal = str(literal).lower() if op == "true" else literal
            text = f"{float(literal)}D" if numeric and op == "ge" else (
                str(literal) if numeric or op == "true" else f"'{literal}'"
            )
            whens.append(f"WHEN k < {STEP * (i + 1)} THEN {text}")
        other = "0" if numeric else ("false" if tests[0][0] == "true" else "'none'")
        return f"CASE {' '.join(whens)} ELSE {other} END"

    def documents(self, spark, sf):
        base = events(spark, sf).withColumn(
            "dataset", F.explode(F.array(*[F.lit(d) for d in self.datasets]))
        )
        names = sorted({n for _, n in self.values})
        fields = {}
        for name in names:
            whens = " ".join(
                f"WHEN '{d}' THEN {snippet}" for (d, n), snippet in self.values.items() if n == name
            )
            fields[name] = f"CASE dataset {whens} END"
        return documents(base, fields, ["event_id", "ts", "dataset"])

    def test_sql(self, job: D.Job) -> str:
        """The job's condition as ranges of k."""
        parts = []
        for name, op, value in job.where:
            tests = self.tested[job.dataset, name]
            i = tests.index((op, value))
            parts.append(f"k >= {STEP * i} AND k < {STEP * (i + 1)}")
        return " AND ".join(parts) or "true"

    def column_sql(self, job: D.Job, name: str) -> str:
        value = self.values[job.dataset, name]
        return value.replace("concat('u', u)", "'u' || u")

    def feed_sql(self) -> str:
        """(job, fn, entity, ts, measure) rows of all jobs."""
        rows = []
        for j in self.jobs:
            entity = " || '|' || ".join(self.column_sql(j, s) for s in j.split) or "''"
            measure = "v" if j.field else "NULL"
            rows.append(
                f"SELECT '{j.key}' AS job, '{j.function}' AS fn, {entity} AS entity, ts, "
                f"CAST({measure} AS DOUBLE) AS m, event_type, u FROM ev WHERE {self.test_sql(j)}"
            )
        return " UNION ALL ".join(rows)


SCORE = (
    "CASE WHEN z IS NULL OR z <= 0 OR n < 8 THEN CAST(0 AS DOUBLE) "
    "ELSE least(CAST(100 AS DOUBLE), 10 * log10(1 + exp(1.702 * z))) END"
)


def scores_sql(layout: Layout) -> str:
    return scores_over(layout.feed_sql())


def scores_over(feed: str, closed: str = "true", seconds: int = SECONDS) -> str:
    """CTEs up to ``scores(job, entity, b, function, actual, typical, seen, score)``.

    Count detectors are zero-filled explicitly here, which is what the RANGE frame of the plan
    stands for.
    """
    counts = ", ".join(f"'{f}'" for f in D.COUNTS)
    frame = "OVER (PARTITION BY job, entity ORDER BY b ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)"
    return f"""{EV}, feed AS ({feed}),
  bk AS (SELECT job, fn, entity, {bucket_sql(seconds)} AS b, count(*) AS docs, count(m) AS vals,
           sum(m) AS total, max(m) AS peak FROM feed GROUP BY 1, 2, 3, 4 HAVING {closed}),
  ends AS (SELECT job, max(b) AS last FROM bk GROUP BY 1),
  spine AS (SELECT s.job, s.fn, s.entity, unnest(range(s.first, e.last + 1, {seconds})) AS b FROM
      (SELECT job, fn, entity, min(b) AS first FROM bk WHERE fn IN ({counts}) GROUP BY 1, 2, 3) s
      JOIN ends e ON e.job = s.job),
  filled AS (SELECT s.job, s.fn, s.entity, CAST(s.b AS BIGINT) AS b,
      CAST(coalesce(bk.docs, 0) AS DOUBLE) AS x FROM spine s
      LEFT JOIN bk ON bk.job = s.job AND bk.entity = s.entity AND bk.b = s.b),
  vals AS (SELECT job, fn, entity, b, CASE WHEN fn LIKE '%mean' THEN total / vals
      WHEN fn = 'high_sum' THEN total ELSE peak END AS x FROM bk
      WHERE fn NOT IN ({counts}, 'rare') AND vals > 0),
  both_ AS (SELECT * FROM filled UNION ALL SELECT job, fn, entity, b, x FROM vals),
  st AS (SELECT *, avg(x) {frame} AS mu, stddev_samp(x) {frame} AS sd, count(*) {frame} AS n
      FROM both_),
  zs AS (SELECT *, greatest(CAST(-100 AS DOUBLE), least(CAST(100 AS DOUBLE),
      (x - mu) / greatest(sd, 0.01 * abs(mu), 1e-9))) AS z0 FROM st),
  zd AS (SELECT *, CASE WHEN fn LIKE 'low%' THEN -z0 WHEN fn = 'count' THEN abs(z0) ELSE z0 END AS z
      FROM zs),
  seen AS (SELECT job, entity, b, docs, row_number() OVER (PARTITION BY job, entity ORDER BY b) - 1
      AS prior FROM bk WHERE fn = 'rare'),
  numbered AS (SELECT job, b, row_number() OVER (PARTITION BY job ORDER BY b) - 1 AS n
      FROM (SELECT DISTINCT job, b FROM seen)),
  rare AS (SELECT s.job, s.entity, s.b, CAST(docs AS DOUBLE) AS x, n,
      CASE WHEN n > 0 THEN prior / CAST(n AS DOUBLE) END AS f FROM seen s
      JOIN numbered m ON m.job = s.job AND m.b = s.b),
  scores AS (SELECT job, entity, b, fn AS function, x AS actual, mu AS typical, n AS seen,
      {SCORE} AS score FROM zd WHERE fn <> 'high_count' OR x > 0
    UNION ALL SELECT job, entity, b, 'rare', x, f, n, CASE WHEN n >= 8 AND f < 0.05
      THEN 100 * (1 - f / 0.05) ELSE CAST(0 AS DOUBLE) END FROM rare)"""


def shaped(df):
    return df.select(
        "job", "entity", secs("bucket").alias("b"), "function", r4(F.col("actual")).alias("actual"),
        r4(F.col("score")).alias("score"), "seen",
    )


def detect_group(group: str, spark, sf):
    jobs = J.jobs_of(group)
    return shaped(D.detect(Layout(jobs).documents(spark, sf), jobs, SPAN))


for _group in J.CATALOGUE:
    query(
        f"detect_{_group.replace('-', '_')}",
        f"""WITH {scores_sql(Layout(J.jobs_of(_group)))} SELECT job, entity, b, function,
            {r4_sql("actual")} AS actual, {r4_sql("score")} AS score, seen FROM scores""",
    )(partial(detect_group, _group))


@query(
    "detect_records_listed",
    f"""WITH {scores_sql(Layout(J.jobs_of("compute")))} SELECT job, entity, b, {r4_sql("score")}
        AS score FROM scores WHERE score >= 50 ORDER BY scores.score DESC, job, entity, b LIMIT 10""",
)
def records_listed(spark, sf):
    jobs = J.jobs_of("compute")
    out = D.listed(D.detect(Layout(jobs).documents(spark, sf), jobs, SPAN))
    return out.select("job", "entity", secs("bucket").alias("b"), r4(F.col("score")).alias("score"))


@query(
    "detect_swimlane",
    f"""WITH {scores_sql(Layout(J.jobs_of("analytics")))} SELECT job, b // 86400 * 86400 AS slot,
        {r4_sql("max(score)")} AS score FROM scores GROUP BY 1, 2""",
)
def swimlane(spark, sf):
    jobs = J.jobs_of("analytics")
    out = D.swimlane(D.detect(Layout(jobs).documents(spark, sf), jobs, SPAN), "1 day")
    return out.select("job", secs("slot").alias("slot"), r4(F.col("score")).alias("score"))


INFLUENCED = [j for j in J.jobs_of("storage") if j.function == "high_count"]


@query(
    "detect_influencers",
    f"""WITH {scores_sql(Layout(INFLUENCED))}, hit AS (SELECT job, entity, b FROM scores
          WHERE score >= 20),
        c AS (SELECT f.job, f.entity, {bucket_sql(SECONDS)} AS b, unnest([
            {{'field': 'aws.s3access.bucket', 'value': 'u' || u}},
            {{'field': 'cloud.account.id', 'value': 'u' || u}},
            {{'field': 'cloud.region', 'value': event_type}}], recursive := true) FROM feed f),
        g AS (SELECT job, entity, b, field, value, count(*) AS docs FROM c GROUP BY 1, 2, 3, 4, 5),
        r AS (SELECT g.*, row_number() OVER (PARTITION BY g.job, g.entity, g.b, field
            ORDER BY docs DESC, value) AS rank, sum(docs) OVER (PARTITION BY g.job, g.entity, g.b,
            field) AS whole FROM g JOIN hit USING (job, entity, b))
        SELECT job, entity, b, field, value, CAST(rank AS INT) AS rank, docs,
          {r4_sql("docs / CAST(whole AS DOUBLE)")} AS share FROM r WHERE rank <= 3""",
)
def influencers(spark, sf):
    docs = Layout(INFLUENCED).documents(spark, sf)
    flagged = D.detect(docs, INFLUENCED, SPAN).filter(F.col("score") >= 20)
    out = D.influencers(docs, INFLUENCED, flagged, SPAN)
    return out.select(
        "job", "entity", secs("bucket").alias("b"), "field", "value", "rank", "docs",
        r4(F.col("share")).alias("share"),
    )


# One query per detector function: six-hour buckets per event type.
FUNCTIONS = [*D.COUNTS, *D.VALUES, D.RARE]


def function_job(function: str) -> D.Job:
    split = ("kind", "key") if function == D.RARE else ("kind",)
    return D.Job("functions", function, "all", function, "value", split)


def function_feed(function: str) -> str:
    entity = "event_type || '|' || k" if function == D.RARE else "event_type"
    return (
        f"SELECT 'functions/{function}' AS job, '{function}' AS fn, {entity} AS entity, ts, v AS m FROM ev"
    )


def detect_function(function: str, spark, sf):
    docs = events(spark, sf).select(
        "ts", F.lit("all").alias("dataset"), F.col("event_type").alias("kind"),
        F.col("k").cast("string").alias("key"), F.col("v").alias("value"),
    )
    return shaped(D.detect(docs, [function_job(function)], "6 hours"))


for _function in FUNCTIONS:
    query(
        f"detector_{_function}",
        f"""WITH {scores_over(function_feed(_function), seconds=21600)} SELECT job, entity, b, function,
            {r4_sql("actual")} AS actual, {r4_sql("score")} AS score, seen FROM scores""",
    )(partial(detect_function, _function))


@query(
    "join_zero_fill_spine",
    f"""WITH {EV}, e AS (SELECT u, {bucket_sql(3600)} AS b, count(*) AS n FROM ev GROUP BY 1, 2),
        s AS (SELECT u, unnest(range(min(b), (SELECT max(b) FROM e) + 1, 3600)) AS b FROM e GROUP BY u)
        SELECT CAST(s.u AS VARCHAR) AS entity, s.b, coalesce(n, 0) AS docs FROM s
        LEFT JOIN e ON e.u = s.u AND e.b = s.b""",
)
def zero_fill_spine(spark, sf):
    """Silent hours of every user, from its first to the last hour of the job."""
    job = D.Job("spine", "low", "all", "low_count", split=("user",))
    docs = events(spark, sf).select(
        "ts", F.lit("all").alias("dataset"), F.col("u").cast("string").alias("user")
    )
    filled = D.empty_buckets(D.bucketise(D.datafeed(docs, [job]), "1 hour"), [job], 3600)
    return filled.select("entity", secs("bucket").alias("b"), "docs")


SPANNED = [
    D.Job("spans", "quarter", "all", "high_count", split=("kind",)),
    D.Job("spans", "hour", "all", "high_mean", "value", ("kind",), span="60 minutes"),
]


def spanned_sql(job: D.Job) -> str:
    feed = f"SELECT '{job.key}' AS job, '{job.function}' AS fn, event_type AS entity, ts, v AS m FROM ev"
    return (
        f"SELECT * FROM (WITH {scores_over(feed, seconds=D.span_seconds(job.span))} SELECT job, entity, b, "
        f"function, {r4_sql('actual')} AS actual, {r4_sql('score')} AS score, seen FROM scores)"
    )


@query("detect_spans_per_job", " UNION ALL ".join(spanned_sql(j) for j in SPANNED))
def spans_per_job(spark, sf):
    """Jobs of 15 and 60 minutes in one call."""
    docs = events(spark, sf).select(
        "ts", F.lit("all").alias("dataset"), F.col("event_type").alias("kind"), F.col("v").alias("value")
    )
    return shaped(D.detect(docs, SPANNED))


@query(
    "detect_influencers_spans",
    f"""WITH {EV}, c AS (
          SELECT '{SPANNED[0].key}' AS job, event_type AS entity, {bucket_sql(900)} AS b, 'r' || k % 4 AS value
            FROM ev
          UNION ALL SELECT '{SPANNED[1].key}', event_type, {bucket_sql(3600)}, 'r' || k % 4 FROM ev),
        g AS (SELECT job, entity, b, value, count(*) AS docs FROM c GROUP BY 1, 2, 3, 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY job, entity, b ORDER BY docs DESC, value) AS rank,
            sum(docs) OVER (PARTITION BY job, entity, b) AS whole FROM g)
        SELECT job, entity, b, 'cloud.region' AS field, value, CAST(rank AS INT) AS rank, docs,
          {r4_sql("docs / CAST(whole AS DOUBLE)")} AS share FROM r WHERE rank <= 3 AND whole >= 4""",
)
def influencers_spans(spark, sf):
    """Every flagged bucket has the length of its own job's span."""
    base = events(spark, sf).select(
        "ts", F.lit("all").alias("dataset"), F.col("event_type").alias("kind"), F.col("v").alias("value"),
        F.struct(F.concat(F.lit("r"), F.col("k") % 4).alias("region")).alias("cloud"),
    )
    jobs = [replace(j, influencers=("cloud.region",)) for j in SPANNED]
    flagged = [
        D.bucketise(D.datafeed(base, mine), span).filter("docs >= 4") for span, mine in D.by_span(jobs).items()
    ]
    out = D.influencers(base, jobs, flagged[0].unionByName(flagged[1]))
    return out.select(
        "job", "entity", secs("bucket").alias("b"), "field", "value", "rank", "docs",
        r4(F.col("share")).alias("share"),
    )

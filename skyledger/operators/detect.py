"""Anomaly detection: datafeed, buckets, detectors, scores, influencers.

The score is this package's own definition (the model it stands for is not public):
``z = (x - mu) / max(sd, 1% of |mu|, 1e-9)`` against the previous ``HISTORY`` buckets of the
entity, and ``10 * log10(1 + exp(1.702 z))`` capped at 100, or 0 before ``WARM_UP`` buckets.

Shape of the plan: one scan serves all jobs of a call, rows fan out only to the jobs whose
condition they meet, and everything after the first aggregation works on (job, entity, bucket)
rows. A hot entity therefore reaches the windows as at most one row per bucket of time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.functions.fields import pick
from skyledger.session import stage

SPAN = "15 minutes"
QUERY_DELAY = "60 seconds"
HISTORY = 96
WARM_UP = 8
RARE_SHARE = 0.05
MAJOR, LISTED = 75.0, 50.0

COUNTS = ("high_count", "low_count", "count")
VALUES = ("high_mean", "low_mean", "high_sum", "high_max")
RARE = "rare"
# Detectors for which an empty bucket can itself be the anomaly.
NEEDS_EMPTY = ("low_count", "count")


@dataclass(frozen=True)
class Job:
    """One detector: which documents, which function of which field, split by what.

    ``where`` holds (field, operator, value) conditions; operators are eq, in, ge and true.
    """

    group: str
    id: str
    dataset: str
    function: str
    field: str = ""
    split: tuple[str, ...] = ()
    where: tuple[tuple, ...] = ()
    influencers: tuple[str, ...] = ("cloud.region", "cloud.account.id")
    signal: str = "logs"
    span: str = SPAN

    @property
    def key(self) -> str:
        """Job ids repeat across groups, so the group is part of the key."""
        return f"{self.group}/{self.id}"


def kind_of(op: str, value) -> str:
    """The type in which a condition reads its field."""
    if op not in ("eq", "in", "ge", "true"):
        raise ValueError(f"unknown operator {op}")
    number = op == "ge" or (op == "eq" and isinstance(value, (int, float)))
    return "double" if number else "boolean" if op == "true" else "string"


def fields_of(job: Job) -> set[tuple[str, str]]:
    """Every (field, type) that a job reads."""
    tested = {(name, kind_of(op, value)) for name, op, value in job.where}
    measured = {(job.field, "double")} if job.field else set()
    return tested | measured | {(name, "string") for name in job.split}


def condition(df: DataFrame, job: Job, read) -> Column:
    """Dataset and signal of the job plus its own conditions; ``read`` gives a field's column."""
    test = F.col("dataset") == job.dataset
    if "signal" in df.columns:
        test &= F.col("signal") == job.signal
    for name, op, value in job.where:
        found = read(name, kind_of(op, value))
        if op == "in":
            test &= found.isin(*value)
        elif op == "ge":
            test &= found >= float(value)
        elif op == "true":
            test &= found
        else:
            test &= found == (float(value) if isinstance(value, (int, float)) else value)
    return F.coalesce(test, F.lit(False))


def entity(values: list[Column]) -> Column:
    """The split values of a row as one key; jobs without a split have one entity.

    Bars and backslashes inside a value are escaped and a missing value is ``\\N``, so that different
    values never make the same key.
    """
    if not values:
        return F.lit("")
    plain = lambda v: F.replace(
        F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")
    )
    return F.concat_ws("|", *[F.coalesce(plain(v), F.lit("\\N")) for v in values])


def datafeed(docs: DataFrame, jobs: list[Job], *extra: Column) -> DataFrame:
    """Rows (job, entity, ts, measure) for every job a document belongs to.

    Each field is read out of a document once, in a column of its own, for the datasets whose jobs use
    it; the jobs then only look at those columns.
    """
    datasets = sorted({j.dataset for j in jobs})
    users: dict[tuple[str, str], set[str]] = {}
    for j in jobs:
        for key in fields_of(j):
            users.setdefault(key, set()).add(j.dataset)
    names = {key: f"_field{i}" for i, key in enumerate(sorted(users))}
    read = lambda name, kind: F.col(names[name, kind])
    kept = ["ts", "dataset", *(["signal"] if "signal" in docs.columns else [])]
    feed = docs.filter(F.col("dataset").isin(*datasets)).select(
        *kept, *extra,
        *[
            F.when(F.col("dataset").isin(*sorted(users[key])), pick(docs, *key)).alias(column)
            for key, column in names.items()
        ],
    )
    hits = [
        F.when(
            condition(docs, j, read),
            F.struct(
                F.lit(j.key).alias("job"),
                entity([read(s, "string") for s in j.split]).alias("entity"),
                (read(j.field, "double") if j.field else F.lit(None).cast("double")).alias("measure"),
            ),
        )
        for j in jobs
    ]
    carried = [F.col(f"`{name}`") for name in _names(docs, extra)]
    return feed.select("ts", *carried, F.explode(F.array_compact(F.array(*hits))).alias("_hit")).select(
        "ts", "_hit.*", *carried
    )


def _names(df: DataFrame, extra) -> list[str]:
    return df.select(*extra).columns if extra else []


def bucketise(feed: DataFrame, span: str = SPAN) -> DataFrame:
    """Per job, entity and tumbling bucket, what every detector needs."""
    return (
        feed.groupBy("job", "entity", F.window("ts", span).alias("_w"))
        .agg(
            F.count("*").alias("docs"),
            F.count("measure").alias("values"),
            F.sum("measure").alias("total"),
            F.max("measure").alias("peak"),
        )
        .select("job", "entity", F.col("_w.start").alias("bucket"), "docs", "values", "total", "peak")
    )


def _lookup(jobs: list[Job], pairs) -> Column:
    """A map literal over the handful of jobs of this call."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for j in jobs for x in (j.key, pairs(j))]), F.col("job")
    )


def score_of(z: Column, n: Column) -> Column:
    """D13 and D14."""
    raised = F.lit(10.0) * F.log10(F.lit(1.0) + F.exp(F.lit(1.702) * z))
    return F.when((z <= 0) | z.isNull() | (n < WARM_UP), F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), raised)
    )


def deviation(x: Column, mu: Column, sd: Column) -> Column:
    floor = F.greatest(sd, F.lit(0.01) * F.abs(mu), F.lit(1e-9))
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), (x - mu) / floor))


def directed(function: Column, z: Column) -> Column:
    """Which tail counts: high detectors the upper, low detectors the lower, count both."""
    return F.when(function.startswith("low_"), -z).when(function == "count", F.abs(z)).otherwise(z)


def empty_buckets(buckets: DataFrame, jobs: list[Job], seconds: int) -> DataFrame:
    """The buckets of jobs in ``NEEDS_EMPTY`` with zero rows for silent buckets.

    The spine of an entity runs from its first bucket to the last bucket of the job. Every
    filled bucket is repeated up to the next one, so only filled buckets are shuffled; the rows
    made here stay in the partitions that the scoring window needs. Upper-tail counts need no
    zero rows: see ``score_counts``. A caller that has scored a part already names it in a column
    ``since``: no zero rows are made up to there.
    """
    keys = [j.key for j in jobs if j.function in NEEDS_EMPTY]
    # A fixed number of partitions: adaptive execution would size them by the filled buckets
    # alone and leave all the zero rows to a few tasks.
    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = buckets.filter(F.col("job").isin(*keys))
    chosen = mine.repartition(tasks, "job", "entity")
    # One row per job of this call: bounded by the length of the job list.
    ends = mine.groupBy("job").agg(F.max("bucket").alias("_end"))
    step = F.make_interval(secs=F.lit(seconds))
    following = F.lead("bucket").over(Window.partitionBy("job", "entity").orderBy("bucket"))
    last = F.coalesce(F.col("_next") - step, F.col("_end"))
    begin = F.col("bucket") + step
    if "since" in buckets.columns:
        begin = F.greatest(begin, F.col("since") + step)  # greatest() passes over a missing since
    silent = F.when(begin <= last, F.sequence(begin, last, step))
    nothing = F.array().cast("array<timestamp>")
    spread = (
        chosen.join(F.broadcast(ends), "job")
        .withColumn("_next", following)
        .withColumn(
            "_slot", F.explode(F.concat(F.array("bucket"), F.coalesce(silent, nothing)))
        )
    )
    filled = F.col("_slot") == F.col("bucket")
    zero = F.lit(0).cast("bigint")
    return spread.select(
        "job", "entity", F.col("_slot").alias("bucket"),
        F.when(filled, F.col("docs")).otherwise(zero).alias("docs"),
        F.when(filled, F.col("values")).otherwise(zero).alias("values"),
        F.when(filled, F.col("total")).alias("total"),
        F.when(filled, F.col("peak")).alias("peak"),
        *([F.col("first_bucket")] if "first_bucket" in buckets.columns else []),
    )


def _numbered(df: DataFrame, jobs: list[Job], span_seconds: int, names) -> DataFrame:
    """The buckets of the jobs whose function is among ``names``, with a bucket number."""
    chosen = [j for j in jobs if j.function in names]
    return (
        df.filter(F.col("job").isin(*[j.key for j in chosen]))
        .withColumn("function", _lookup(chosen, lambda j: j.function))
        .withColumn("_b", F.floor(F.unix_seconds("bucket") / span_seconds).cast("bigint"))
    )


def _scored(df: DataFrame, n: Column, mu: Column, sd: Column) -> DataFrame:
    df = df.withColumns({"seen": n, "typical": mu, "_sd": sd})
    z = directed(F.col("function"), deviation(F.col("actual"), F.col("typical"), F.col("_sd")))
    return df.select(
        "job", "entity", "bucket", "function", "actual", "typical", "seen",
        score_of(z, F.col("seen")).alias("score"),
    )


def score_counts(
    buckets: DataFrame, jobs: list[Job], span_seconds: int = 900, history: int = HISTORY
) -> DataFrame:
    """Counts against the previous ``history`` buckets, silent ones included.

    Frames are RANGE frames over the bucket number, so buckets without rows count as zeros
    without being stored: an empty bucket can never score in the upper tail, and ``high_count``
    needs no zero-filled spine. Sums over the last ``history`` buckets are differences of two
    running sums, in integers and so without rounding; each row then costs the same however
    long the history is.

    A caller that only holds recent buckets adds ``first_bucket`` per row, so that the number of
    buckets an entity has lived through stays right.
    """
    parts = []
    if any(j.function in NEEDS_EMPTY for j in jobs):
        spine = empty_buckets(buckets, jobs, span_seconds)
        parts.append(_score_counts(spine, jobs, NEEDS_EMPTY, span_seconds, history))
    upper = tuple(f for f in COUNTS if f not in NEEDS_EMPTY)
    if any(j.function in upper for j in jobs):
        parts.append(_score_counts(buckets, jobs, upper, span_seconds, history))
    return reduce(DataFrame.unionByName, parts)


def _score_counts(
    buckets: DataFrame, jobs: list[Job], names: tuple[str, ...], span_seconds: int, history: int
) -> DataFrame:
    df = _numbered(buckets, jobs, span_seconds, names)
    ordered = Window.partitionBy("job", "entity").orderBy("_b")
    born = F.first("_b").over(ordered)
    if "first_bucket" in df.columns:
        known = F.max("first_bucket").over(Window.partitionBy("job", "entity"))
        born = F.coalesce(F.floor(F.unix_seconds(known) / span_seconds).cast("bigint"), born)
    wide = F.col("docs").cast("decimal(19,0)")

    def recent(x: Column) -> Column:
        until = lambda last: F.sum(x).over(
            ordered.rangeBetween(Window.unboundedPreceding, last)
        )
        zero = F.lit(0)
        return F.coalesce(until(-1), zero) - F.coalesce(until(-history - 1), zero)

    df = df.withColumns(
        {
            "actual": F.col("docs").cast("double"),
            "_n": F.least(F.lit(history).cast("bigint"), F.col("_b") - born),
            "_s": recent(F.col("docs")).cast("double"),
            "_q": recent((wide * wide).cast("decimal(38,0)")).cast("double"),
        }
    )
    mu = F.try_divide(F.col("_s"), F.col("_n"))
    spread = F.try_divide(
        F.col("_q") - F.try_divide(F.col("_s") * F.col("_s"), F.col("_n")), F.col("_n") - 1
    )
    return _scored(df, F.col("_n"), mu, F.sqrt(F.greatest(spread, F.lit(0.0))))


def score_values(
    buckets: DataFrame, jobs: list[Job], span_seconds: int = 900, history: int = HISTORY
) -> DataFrame:
    """Means, sums and maxima against the previous filled buckets (ROWS frame)."""
    df = _numbered(buckets, jobs, span_seconds, VALUES)
    fn = F.col("function")
    x = (
        F.when(fn.endswith("_mean"), F.col("total") / F.col("values"))
        .when(fn == "high_sum", F.col("total"))
        .otherwise(F.col("peak"))
    )
    df = df.withColumn("actual", x).filter(F.col("actual").isNotNull())
    past = Window.partitionBy("job", "entity").orderBy("_b").rowsBetween(-history, -1)
    df = df.withColumns(
        {
            "_n": F.count("actual").over(past),
            "_mu": F.avg("actual").over(past),
            "_dev": F.stddev_samp("actual").over(past),
        }
    )
    return _scored(df, F.col("_n"), F.col("_mu"), F.col("_dev"))


def families(jobs: list[Job]) -> list[str]:
    """Which kinds of detector a list of jobs holds."""
    kinds = {"counts": COUNTS, "values": VALUES, RARE: (RARE,)}
    return [k for k, names in kinds.items() if any(j.function in names for j in jobs)]


def score_buckets(
    buckets: DataFrame, jobs: list[Job], span_seconds: int = 900, history: int = HISTORY
) -> DataFrame:
    """All count and value detectors of the list."""
    parts = []
    if "counts" in families(jobs):
        parts.append(score_counts(buckets, jobs, span_seconds, history))
    if "values" in families(jobs):
        parts.append(score_values(buckets, jobs, span_seconds, history))
    return reduce(DataFrame.unionByName, parts)


def score_rare(buckets: DataFrame, jobs: list[Job], earlier: DataFrame | None = None) -> DataFrame:
    """Values seen in few of the earlier buckets of the job.

    ``earlier`` holds what came before ``buckets``: the number of buckets per (job, entity), and per
    job in the row without an entity.
    """
    keys = [j.key for j in jobs if j.function == RARE]
    seen = buckets.filter(F.col("job").isin(*keys)).select("job", "entity", "bucket", "docs")
    # Every (job, bucket) once, numbered in time order: one row per bucket of time and job.
    numbered = seen.select("job", "bucket").distinct().withColumn(
        "seen", (F.row_number().over(Window.partitionBy("job").orderBy("bucket")) - 1).cast("bigint")
    )
    value = Window.partitionBy("job", "entity").orderBy("bucket")
    prior = (F.row_number().over(value) - 1).cast("bigint")
    df = seen.withColumn("_prior", prior).join(numbered, ["job", "bucket"])
    if earlier is not None:
        of_value = earlier.filter(F.col("entity").isNotNull()).withColumnRenamed("n", "_value")
        of_job = earlier.filter(F.col("entity").isNull()).select("job", F.col("n").alias("_job"))
        add = lambda c, n: F.col(c) + F.coalesce(F.col(n), F.lit(0))
        # One row per job of this call: bounded by the length of the job list.
        df = df.join(of_value, ["job", "entity"], "left").join(F.broadcast(of_job), "job", "left")
        df = df.withColumns({"_prior": add("_prior", "_value"), "seen": add("seen", "_job")})
    f = F.try_divide(F.col("_prior").cast("double"), F.col("seen").cast("double"))
    score = F.when(
        (F.col("seen") >= WARM_UP) & (f < RARE_SHARE), F.lit(100.0) * (1 - f / RARE_SHARE)
    ).otherwise(F.lit(0.0))
    return df.select(
        "job", "entity", "bucket", F.lit(RARE).alias("function"),
        F.col("docs").cast("double").alias("actual"),
        f.alias("typical"), "seen", score.alias("score"),
    )


def score(buckets: DataFrame, jobs: list[Job], span_seconds: int = 900) -> DataFrame:
    """All detectors over one table of buckets."""
    parts = []
    if {"counts", "values"} & set(families(jobs)):
        parts.append(score_buckets(buckets, jobs, span_seconds))
    if RARE in families(jobs):
        parts.append(score_rare(buckets, jobs))
    return reduce(DataFrame.unionByName, parts)


def by_span(jobs: list[Job]) -> dict[str, list[Job]]:
    """The jobs of every bucket span."""
    return {s: [j for j in jobs if j.span == s] for s in sorted({j.span for j in jobs})}


def detect(docs: DataFrame, jobs: list[Job], span: str | None = None) -> DataFrame:
    """D1-D14 over a batch of documents with ``ts`` and ``dataset``; D17's backfill form.

    Jobs have buckets of their own ``span``, unless one is given for all. The documents are scanned once
    per span: where several detectors read the buckets, the buckets are staged first.
    """
    if span is None:
        parts = [detect(docs, mine, s) for s, mine in by_span(jobs).items()]
        return reduce(DataFrame.unionByName, parts)
    buckets = bucketise(datafeed(docs, jobs), span)
    shared = len(families(jobs)) > 1 or RARE in families(jobs)
    if shared or any(j.function in NEEDS_EMPTY for j in jobs):
        buckets = stage(buckets, "buckets")
    return score(buckets, jobs, span_seconds(span))


def span_seconds(span: str) -> int:
    number, unit = span.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * scale[unit.rstrip("s")]


def listed(scores: DataFrame, minimum: float = LISTED, n: int = 10, since=None) -> DataFrame:
    """The highest recent records."""
    df = scores.filter(F.col("score") >= minimum)
    if since is not None:
        df = df.filter(F.col("bucket") >= since)
    return df.orderBy(F.desc("score"), "job", "entity", "bucket").limit(n)


def swimlane(scores: DataFrame, span: str = SPAN) -> DataFrame:
    """Highest score per job and time slot."""
    slot = F.window("bucket", span).getField("start").alias("slot")
    return scores.groupBy("job", slot).agg(F.max("score").alias("score"))


def influencers(
    docs: DataFrame, jobs: list[Job], flagged: DataFrame, span: str | None = None, k: int = 3
) -> DataFrame:
    """For every flagged bucket, the field values that contribute the most documents.

    Buckets are those of each job's ``span``, unless one is given for all. Only documents from the first
    to the last flagged bucket are read. Contributions are counted before they meet the flagged buckets,
    so what is shuffled is one row per (bucket, field, value); ranking is a top-k per bucket that Spark
    prunes per task.
    """
    keys = ["job", "entity", "bucket"]
    wanted = stage(flagged.select(*keys).distinct(), "flagged")
    parts = []
    for own, mine in ({span: jobs} if span else by_span(jobs)).items():
        here = wanted.filter(F.col("job").isin(*[j.key for j in mine]))
        first, last = here.agg(F.min("bucket"), F.max("bucket")).first()
        if first is None:
            continue
        end = F.lit(last) + F.make_interval(secs=F.lit(span_seconds(own)))
        timely = docs.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") < end))
        counted = _contributions(timely, mine, own)
        parts.append(counted.join(here, keys, "left_semi"))
    if not parts:
        parts = [_contributions(docs.limit(0), jobs, span or SPAN)]
    near = stage(reduce(DataFrame.unionByName, parts), "influencers")
    whole = near.groupBy(*keys, "field").agg(F.sum("docs").alias("_all"))
    best = Window.partitionBy(*keys, "field").orderBy(F.desc("docs"), "value")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(whole, [*keys, "field"])
        .select(*keys, "field", "value", "rank", "docs", (F.col("docs") / F.col("_all")).alias("share"))
    )


def _contributions(docs: DataFrame, jobs: list[Job], span: str) -> DataFrame:
    """Documents per job, entity, bucket and value of an influencer field."""
    names = sorted({name for j in jobs for name in j.influencers})
    pairs = F.array(
        *[F.struct(F.lit(n).alias("field"), pick(docs, n).alias("value")) for n in names]
    )
    used = F.create_map(
        *[x for j in jobs for x in (F.lit(j.key), F.array(*[F.lit(n) for n in j.influencers]))]
    )
    feed = datafeed(docs, jobs, pairs.alias("_pairs"))
    rows = feed.select(
        "job", "entity", F.window("ts", span).getField("start").alias("bucket"),
        F.explode("_pairs").alias("_p"),
    ).filter(
        F.array_contains(F.try_element_at(used, F.col("job")), F.col("_p.field"))
        & F.col("_p.value").isNotNull()
    )
    return rows.groupBy(
        "job", "entity", "bucket",
        F.col("_p.field").alias("field"), F.col("_p.value").alias("value"),
    ).agg(F.count("*").alias("docs"))

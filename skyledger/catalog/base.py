"""Query catalogue: registered plans, their comparison SQL, and the input tables.

The tables stand in for observability data. Every derivation reads a whole table and maps its
columns; nothing is sampled or cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import configure

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is the equivalent statement for the comparison engine."""

    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as (event_id, ts, u, event_type, v, k, props)."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"),
        "event_type", F.col("value").alias("v"), k.alias("k"), "props",
    )


EV = (
    "ev AS (SELECT event_id, ts, user_id AS u, event_type, value AS v, "
    "CAST(props->>'$.k' AS INT) AS k, props FROM events)"
)


def r4(x: Column) -> Column:
    """Four decimals; the small shift keeps halves from falling differently in two engines."""
    return F.floor(x * 10000 + F.lit(0.5000001).cast("double")).cast("double") / 10000


def r4_sql(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * 10000 + CAST(0.5000001 AS DOUBLE)) / 10000)"


def secs(ts: Column | str) -> Column:
    """Epoch seconds of a timestamp column."""
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def micros_sql(ts: str = "ts") -> str:
    return f"epoch_us({ts})"


def secs_sql(ts: str = "ts") -> str:
    return f"CAST(epoch_us({ts}) // 1000000 AS BIGINT)"


def bucket_sql(seconds: int, ts: str = "ts") -> str:
    return f"CAST(epoch_us({ts}) // {seconds * 1000000} * {seconds} AS BIGINT)"


def nest(values: dict[tuple[str, ...], Column]) -> Column:
    """A nested struct from columns addressed by key paths."""
    groups: dict[str, dict[tuple[str, ...], Column]] = {}
    leaves: dict[str, Column] = {}
    for path, value in values.items():
        if len(path) == 1:
            leaves[path[0]] = value
        else:
            groups.setdefault(path[0], {})[path[1:]] = value
    parts = [v.alias(n) for n, v in leaves.items()]
    parts += [nest(sub).alias(n) for n, sub in groups.items()]
    return F.struct(*parts)


def documents(df: DataFrame, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """Common-schema documents: dotted names from SQL snippets, ``aws`` as a VARIANT tail."""
    roots: dict[str, dict[tuple[str, ...], Column]] = {}
    for name, snippet in fields.items():
        root, *rest = name.split(".")
        roots.setdefault(root, {})[tuple(rest)] = F.expr(snippet)
    columns = []
    for root, values in roots.items():
        body = nest(values)
        columns.append((F.to_variant_object(body) if root == "aws" else body).alias(root))
    return df.select(*keep, *columns)


def columns_sql(fields: dict[str, str]) -> str:
    """The same fields as flat, quoted columns."""
    return ", ".join(f'{snippet} AS "{name}"' for name, snippet in fields.items())

"""Data quality: rule tables evaluated in one pass, coverage and agreement reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fields import pick
from skyledger.operators.stats import FAILURE
from skyledger.session import stage
from skyledger.sources.sinks import Rule


def rule_report(df: DataFrame, rules: list[Rule], by: tuple[str, ...] = ()) -> DataFrame:
    """Q1: rows checked and rows failing per rule, in long form, from one aggregation."""
    checks = [F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(r.name) for r in rules]
    wide = df.groupBy(*by).agg(F.count("*").alias("checked"), *checks)
    return wide.unpivot([*by, "checked"], [r.name for r in rules], "rule", "failed")


def base_rules(df: DataFrame) -> list[Rule]:
    """Q1 and Q2: what every log document has to carry."""
    text = lambda name: F.coalesce(F.length(pick(df, name)) > 0, F.lit(False))
    return [
        Rule("timestamp", F.col("ts").isNotNull()),
        Rule("cloud_provider", pick(df, "cloud.provider") == "aws"),
        Rule("cloud_region", text("cloud.region")),
        Rule("cloud_account", text("cloud.account.id")),
        Rule("message", text("message")),
        Rule("outcome", pick(df, "event.outcome").isin("success", "failure", "unknown")),
        Rule("duration", F.coalesce(pick(df, "event.duration", "double") > 0, F.lit(True))),
    ]


def outcome_rules(outcome: Column, has_error: Column) -> list[Rule]:
    """Q3: a failure carries an error block, a success carries none."""
    return [
        Rule("failure_without_error", (outcome != FAILURE) | has_error),
        Rule("error_without_failure", (outcome == FAILURE) | ~has_error),
    ]


def error_rules() -> list[Rule]:
    """Q6: what an error document has to carry."""
    first = F.get("exception", F.lit(0))
    return [
        Rule("error_id", F.length("error_id") == 32),
        Rule("trace_id", F.length("trace_id") == 32),
        Rule("exception_type", F.length(first["type"]) > 0),
        Rule("exception_message", F.length(first["message"]) > 0),
    ]


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q7: columns that still hold NULLs."""
    return rule_report(df, [Rule(c, F.col(f"`{c}`").isNotNull()) for c in columns])


def field_coverage(df: DataFrame, expected: dict[str, list[str]], dataset: str = "dataset") -> DataFrame:
    """Q8: share of documents per dataset that carry each expected field."""
    fields = sorted({f for names in expected.values() for f in names})
    presence = [F.avg(pick(df, f).isNotNull().cast("double")).alias(f) for f in fields]
    wide = df.groupBy(dataset).agg(*presence)
    long = wide.unpivot([dataset], [f"`{f}`" for f in fields], "field", "share")
    wanted = F.lit(False)
    for name, names in expected.items():
        wanted |= (F.col(dataset) == name) & F.col("field").isin(*names)
    return long.filter(wanted)


def field_paths(docs: DataFrame, dataset: str = "dataset", doc: str = "doc") -> DataFrame:
    """Q8 over everything a document holds: dataset, field, docs (that have it), total, share, kinds.

    ``doc`` is a VARIANT. A field is a dotted path to a value that is neither null nor an object; the
    objects of an array count under the path of the array with ``[]``. Documents are first counted by
    their shape, the schema of the whole VARIANT, so that only one document per shape is walked, level by
    level; a document in which a path comes more than once counts once.
    """
    shapes = stage(
        docs.groupBy(dataset, F.schema_of_variant(doc).alias("_shape"))
        .agg(F.count("*").alias("_docs"), F.any_value(doc).alias("_doc"))
        .withColumn("_no", F.monotonically_increasing_id()),
        "shapes",
    )
    open_ = shapes.filter(F.col("_shape").startswith("OBJECT")).select(
        dataset, "_no", F.lit("").alias("_path"), F.col("_doc").alias("_value"),
        F.lit("OBJECT").alias("_kind"),
    )
    found = []
    while not open_.isEmpty():
        inner = open_.lateralJoin(
            open_.sparkSession.tvf.variant_explode(F.col("_value").outer()).toDF("_pos", "_name", "_inner")
        )
        step = F.when(F.col("_kind") == "ARRAY", F.lit("[]")).when(
            F.col("_path") == "", F.col("_name")
        ).otherwise(F.concat(F.lit("."), "_name"))
        kind = F.regexp_extract(F.schema_of_variant("_inner"), "^[A-Z]+", 0)
        level = stage(
            inner.select(
                dataset, "_no", F.concat("_path", step).alias("_path"), F.col("_inner").alias("_value"),
                kind.alias("_kind"),
            ).filter(F.col("_kind") != "VOID"),
            "paths",
        )
        # an array counts itself, and its objects are walked as well; plain elements are not fields
        element = F.col("_path").endswith("[]")
        found.append(level.filter((F.col("_kind") != "OBJECT") & ~element).select(dataset, "_no", "_path", "_kind"))
        open_ = level.filter((F.col("_kind") == "OBJECT") | (F.col("_kind") == "ARRAY"))
    if not found:
        found = [open_.select(dataset, "_no", "_path", "_kind")]
    paths = reduce(DataFrame.unionByName, found)
    one = paths.groupBy(dataset, "_no", "_path").agg(F.collect_set("_kind").alias("_kinds"))
    counted = one.join(shapes.select("_no", "_docs"), "_no").groupBy(dataset, F.col("_path").alias("field")).agg(
        F.sum("_docs").alias("docs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_kinds")))).alias("kinds"),
    )
    total = shapes.groupBy(dataset).agg(F.sum("_docs").alias("total"))
    return counted.join(total, dataset).withColumn("share", F.col("docs") / F.col("total"))


def field_gaps(paths: DataFrame, expected: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Q8: what ``field_paths`` found against ``expected(dataset, field)``: every field of a known dataset
    with its status (present, missing, unexpected).

    A field that no document of the dataset has is missing; a field that is not on the list of a dataset
    is unexpected. Datasets without any list are left out.
    """
    want = expected.select(dataset, "field").distinct().withColumn("_want", F.lit(True))
    listed = paths.join(want.select(dataset).distinct(), dataset, "left_semi")
    both = listed.select(dataset, "field", "docs", "share").join(want, [dataset, "field"], "full")
    status = (
        F.when(F.col("_want").isNull(), "unexpected").when(F.col("docs").isNull(), "missing").otherwise("present")
    )
    zero = F.lit(0)
    return both.select(
        dataset, "field", status.alias("status"), F.coalesce("docs", zero.cast("bigint")).alias("docs"),
        F.coalesce("share", zero.cast("double")).alias("share"),
    )


def dataset_agreement(df: DataFrame, event: Column, stream: Column) -> DataFrame:
    """Q9: documents whose event dataset differs from the dataset of their stream."""
    return (
        df.select(event.alias("event_dataset"), stream.alias("stream_dataset"))
        .filter(~F.col("event_dataset").eqNullSafe(F.col("stream_dataset")))
        .groupBy("event_dataset", "stream_dataset")
        .agg(F.count("*").alias("docs"))
    )


def registry_gaps(registry: DataFrame) -> DataFrame:
    """Q4: registry rows with a missing dataset or source."""
    return registry.filter(
        F.col("logs_dataset").isNull()
        | F.col("metrics_dataset").isNull()
        | F.col("default_source").isNull()
    ).select("service")

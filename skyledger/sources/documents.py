"""Reading documents, canonical tables and time-series folders, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import schema as S
from skyledger.functions import scalars as X
from skyledger.operators.enrich import normalise_category


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One schemaless document per line as a VARIANT column ``doc``.

    ``multi_line`` reads one document (or one list of documents) per file instead.
    """
    reader = spark.read.format("json").option("singleVariantColumn", "doc")
    return reader.option("multiLine", str(multi_line).lower()).load(path)


def read_logs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Log documents in the canonical layout; one typed parse, no second pass."""
    raw = spark.read.schema(S.RAW_LOG).option("multiLine", str(multi_line).lower()).json(path)
    return canonical_logs(raw)


def canonical_logs(raw: DataFrame) -> DataFrame:
    """Raw log rows to the log layout: typed time, list-valued category and type."""
    event = raw.schema["event"].dataType
    parts = [
        normalise_category(F.col("event")[f.name], f.dataType).alias(f.name)
        if f.name in ("category", "type")
        else F.col("event")[f.name].alias(f.name)
        for f in event.fields
    ]
    columns = [X.parse_time(F.col("`@timestamp`")).alias("ts")]
    for name in raw.columns:
        if name == "event":
            columns.append(F.when(F.col("event").isNotNull(), F.struct(*parts)).alias("event"))
        elif name != "@timestamp":
            columns.append(F.col(name))
    return raw.select(*columns)


def read_metrics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Metric documents as long rows."""
    from skyledger.operators.metrics import explode_metrics

    raw = spark.read.schema(S.RAW_METRIC).option("multiLine", str(multi_line).lower()).json(path)
    return explode_metrics(metric_documents(raw))


def metric_documents(raw: DataFrame) -> DataFrame:
    """The document's own dataset wins over the override and the event's dataset."""
    return raw.select(
        X.parse_time(F.col("`@timestamp`")).alias("ts"),
        F.coalesce("data_stream.dataset", "__dataset", "event.dataset").alias("dataset"),
        F.col("metricset.name").alias("metricset"),
        F.col("metricset.period").alias("period_ms"),
        F.col("cloud.region").alias("region"),
        F.col("cloud.account.id").alias("account_id"),
        "aws",
    )


def read_spans(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Transactions and spans in one table."""
    from skyledger.operators.traces import spans_table

    return spans_table(read_documents(spark, path, multi_line))


def read_errors(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    from skyledger.operators.traces import errors_table

    return errors_table(read_documents(spark, path, multi_line))


def read_subscription(spark: SparkSession, path: str) -> DataFrame:
    """Raw subscription events (log group, log stream, time, message)."""
    return spark.read.schema(S.SUBSCRIPTION).json(path)


def stream_documents(
    spark: SparkSession,
    path: str,
    layout: str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """The same folders as an unbounded table."""
    reader = spark.readStream.schema(layout)
    for key, value in options.items():
        reader = reader.option(key, value)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def index_pattern(pattern: str) -> Column:
    """S3: an index pattern such as ``logs-aws.glue*`` as a filter on partition columns.

    Several patterns are separated by commas. The filter only names the partition columns
    ``type``, ``dataset`` and ``namespace``, so no file of another folder is opened; ``scan_index``
    does not even list those folders.
    """
    chosen = None
    for part in pattern.split(","):
        kind, _, rest = part.strip().partition("-")
        stem, _, space = rest.partition("-")
        test = F.col("type") == kind
        test &= like(F.col("dataset"), stem)
        if space:
            test &= like(F.col("namespace"), space)
        chosen = test if chosen is None else chosen | test
    return chosen


def like(column: Column, pattern: str) -> Column:
    """A wildcard test; a plain prefix becomes ``startswith``, which Parquet can use."""
    head, star, tail = pattern.partition("*")
    if not star:
        return column == pattern
    if not tail:
        return column.startswith(head)
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.like(escaped.replace("*", "%"))


def index_globs(root: str, pattern: str) -> list[str]:
    """The folders that an index pattern names, as path globs: one folder level per part."""
    paths = []
    for part in pattern.split(","):
        kind, _, rest = part.strip().partition("-")
        stem, _, space = rest.partition("-")
        paths.append(f"{root.rstrip('/')}/type={kind}/dataset={stem}/namespace={space or '*'}")
    return paths


def scan_index(spark: SparkSession, root: str, pattern: str, layout: str | None = None) -> DataFrame:
    """S3 over a folder written by ``write_data_stream``: only matching folders are listed.

    ``layout`` is the DDL of the stored columns; without it Spark reads the footer of one file. A
    pattern that matches no folder fails with ``PATH_NOT_FOUND``, as a misspelt index does.
    """
    reader = spark.read.option("basePath", root)
    if layout is not None:
        reader = reader.schema(f"{layout}, type STRING, dataset STRING, namespace STRING")
    return reader.parquet(*index_globs(root, pattern)).filter(index_pattern(pattern))


def preview(df: DataFrame, n: int = 10, ts: str = "ts") -> DataFrame:
    """The newest documents as JSON text (a top-n sort, no full sort)."""
    doc = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.orderBy(F.desc(ts), doc).limit(n).select(F.col(ts), doc.alias("doc"))


def union_indices(*frames: DataFrame) -> DataFrame:
    """Datasets under one pattern, missing columns filled with NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out

"""Document enrichment: fill what is missing, keep what the document already says.

All of it is one ``select`` of column expressions. Values that would be random are derived
from a digest of the document key, so that a task that runs twice writes the same document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, VariantType

from skyledger.functions import scalars as X
from skyledger.sources import registry as R

# Fixed values written into enriched documents.
SCHEMA_VERSION = "8.11.0"
AGENT_VERSION = "8.18.0"
COLLECTOR_VERSION = "0.115.0"
SDK_VERSION = "1.31.0"
DEFAULT_ACCOUNT = "814726593401"
DEFAULT_REGION = "us-east-1"


# Tokens of JSON text without white space, as ``to_json`` writes it. All loops are possessive: they never
# go back, and the engine runs them without recursion, however long the text.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NULL_FIELD = rf'\G([^"]*+(?:{_STRING}(?!:null[,}}])[^"]*+)*+){_STRING}:null,?+'
_LAST_COMMA = rf'\G((?:[^",]++|{_STRING}|,(?!\}}))*+),(?=\}})'


def strip_json_nulls(text: Column) -> Column:
    """JSON text without the fields whose value is null, at any depth; elements of arrays stay.

    Both patterns read whole tokens from where the match before ended, so a text that looks like a
    field inside of a string is never taken for one. The first takes null fields out with the comma
    behind them, the second the comma that a last field may leave.
    """
    return F.regexp_replace(F.regexp_replace(text, _NULL_FIELD, "$1"), _LAST_COMMA, "$1")


def strip_nulls(doc: Column) -> Column:
    """JSON text of a document without null-valued keys; array elements stay.

    That holds for structs and maps as well as inside VARIANT values of any depth, whatever their keys.
    """
    return strip_json_nulls(F.to_json(doc, {"ignoreNullFields": "true"}))


def strip_variant_nulls(doc: Column) -> Column:
    """E1 for a VARIANT column: the same document without null fields."""
    return F.try_parse_json(strip_json_nulls(F.to_json(doc)))


def fill_missing(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Coalesce top-level or struct leaves (``a.b``) with a default, never overwriting."""
    by_root: dict[str, dict[str, Column]] = {}
    out = df
    for path, default in defaults.items():
        root, _, leaf = path.partition(".")
        if not leaf:
            present = F.col(root) if root in df.columns else F.lit(None)
            out = out.withColumn(root, F.coalesce(present, default))
        else:
            by_root.setdefault(root, {})[leaf] = default
    for root, leaves in by_root.items():
        out = out.withColumn(root, fill_struct(df, root, leaves))
    return out


def fill_struct(df: DataFrame, root: str, leaves: dict[str, Column]) -> Column:
    """The struct column with its NULL leaves filled; missing leaves are added."""
    known = df.schema[root].dataType.names if root in df.columns else []
    parts = [
        F.coalesce(F.col(root)[n], leaves[n]).alias(n) if n in leaves else F.col(root)[n].alias(n)
        for n in known
    ]
    parts += [value.alias(n) for n, value in leaves.items() if n not in known]
    return F.struct(*parts)


def with_leaves(df: DataFrame, root: str, leaves: dict[str, Column]) -> Column:
    """The struct column with these leaves set; every other field of the document stays."""
    body = df.schema[root].dataType if root in df.columns else None
    known = body.names if isinstance(body, StructType) else []
    parts = [(leaves[n] if n in leaves else F.col(root)[n]).alias(n) for n in known]
    return F.struct(*parts, *[v.alias(n) for n, v in leaves.items() if n not in known])


def whole_or(df: DataFrame, root: str, made: Column) -> Column:
    """The document's own block, whole, or else the made one, in a layout that holds both."""
    if root not in df.columns:
        return made
    own, body = F.col(root), df.schema[root].dataType
    if not isinstance(body, StructType):
        return F.coalesce(own, F.to_variant_object(made) if isinstance(body, VariantType) else own)
    names = df.select(made.alias("_made")).schema["_made"].dataType
    added = [f for f in names.fields if f.name not in body.names]
    mine = F.struct(
        *[own[n].alias(n) for n in body.names],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in added],
    )
    filled = F.struct(
        *[
            (made[f.name] if f.name in names.names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in body.fields
        ],
        *[made[f.name].alias(f.name) for f in added],
    )
    return F.when(own.isNotNull(), mine).when(made.isNotNull(), filled)


def own_context(df: DataFrame, name: str, made: Column) -> Column:
    """A block below ``aws``: the document's own, in the layout of the made one, or else the made one."""
    if "aws" not in df.columns:
        return made
    body = df.schema["aws"].dataType
    layout = df.select(made.alias("_made")).schema["_made"].dataType
    if isinstance(body, VariantType):
        own = F.try_variant_get("aws", f"$.{name}", layout.simpleString())
    elif isinstance(body, StructType) and name in body.names:
        given = body[name].dataType
        if not isinstance(given, StructType):
            return made
        own = F.when(
            F.col("aws")[name].isNotNull(),
            F.struct(
                *[
                    (F.col("aws")[name][f.name] if f.name in given.names else F.lit(None))
                    .cast(f.dataType)
                    .alias(f.name)
                    for f in layout.fields
                ]
            ),
        )
    else:
        return made
    return F.coalesce(own, made)


def agent_block(source: Column, event_type: str, region: Column, digest: Column) -> Column:
    """The shipping agent, by source; traces keep their own block. Agent names are fixed values."""
    token = X.digest_uuid(digest)
    none = F.lit(None).cast("string")

    def block(kind: str, version: str, stem: str, own: Column, ephemeral: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(version).alias("version"),
            F.concat(F.lit(stem + "-"), region).alias("name"),
            own.alias("id"),
            ephemeral.alias("ephemeral_id"),
        )

    if event_type == "traces":
        return F.lit(None).cast(
            "struct<type:string,version:string,name:string,id:string,ephemeral_id:string>"
        )
    if event_type == "metrics":
        return block("metricbeat", AGENT_VERSION, "metricbeat-aws", none, token)
    return (
        F.when(source == "agent", block("elastic-agent", AGENT_VERSION, "elastic-agent", token, none))
        .when(source == "otel", block("otel", COLLECTOR_VERSION, "otel-collector", none, none))
        .otherwise(block("filebeat", AGENT_VERSION, "filebeat-aws", none, token))
    )


def event_defaults(module: Column, dataset: Column, resolved: Column) -> tuple[Column, Column]:
    """Module and dataset; empty text counts as missing."""
    blank = F.lit("")
    return (
        F.coalesce(F.nullif(module, blank), F.lit("aws")),
        F.coalesce(F.nullif(dataset, blank), resolved),
    )


def s3_context(
    service: Column, account: Column, region: Column, ts: Column, digest: Column
) -> Column:
    """Bucket, arn and object key; the date path follows the document time."""
    bucket = F.concat_ws("-", F.lit("aws"), service, F.lit("logs"), account)
    stem = F.concat(service, F.lit("_"), F.upper(F.substring(digest, 1, 20)), F.lit(".log.gz"))
    return F.struct(
        F.struct(bucket.alias("name"), F.concat(F.lit("arn:aws:s3:::"), bucket).alias("arn")).alias(
            "bucket"
        ),
        F.struct(
            F.concat_ws(
                "/", F.lit("AWSLogs"), account, service, region, X.date_path(ts), stem
            ).alias("key")
        ).alias("object"),
    )


def cloudwatch_context(service: Column, region: Column, ts: Column, digest: Column) -> Column:
    """Log group, log stream and ingestion time."""
    return F.struct(
        F.concat(F.lit("/aws/"), service, F.lit("/logs")).alias("log_group"),
        F.concat_ws("/", region, F.substring(digest, 1, 8)).alias("log_stream"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ingestion_time"),
    )


def firehose_context(
    source: Column, service: Column, region: Column, account: Column, digest: Column
) -> Column:
    """Only for documents delivered by the delivery stream."""
    stream = F.concat(
        F.lit("arn:aws:firehose:"), region, F.lit(":"), account,
        F.lit(":deliverystream/aws-"), service, F.lit("-stream"),
    )
    block = F.struct(stream.alias("arn"), X.digest_uuid(digest).alias("request_id"))
    return F.when(source == "firehose", block)


def is_compute(service: Column) -> Column:
    """E11."""
    return service.isin(*R.COMPUTE_SERVICES)


def host_block(service: Column, digest: Column, name: Column, hostname: Column) -> Column:
    """Host fields for compute services that carry no host name yet."""
    octets = [F.conv(F.substring(digest, p, 2), 16, 10) for p in (1, 3, 5, 7)]
    made_name = F.concat(F.lit("ip-"), F.concat_ws("-", *octets), F.lit(".ec2.internal"))
    made_host = F.concat(service, F.lit("-"), F.substring(digest, 9, 8))
    fresh = is_compute(service) & name.isNull()
    return F.struct(
        F.when(fresh, made_name).otherwise(name).alias("name"),
        F.when(fresh, made_host).otherwise(hostname).alias("hostname"),
    )


def service_block(service: Column, name: Column, kind: Column) -> Column:
    """The service name and type, filled together when the name is missing."""
    blank = F.nullif(name, F.lit(""))
    return F.struct(
        F.coalesce(blank, service).alias("name"),
        F.when(blank.isNull(), F.coalesce(kind, F.lit("aws"))).otherwise(kind).alias("type"),
    )


def log_level(level: Column) -> Column:
    """E12."""
    return F.coalesce(level, F.lit("info"))


def otel_block(source: Column) -> Column:
    """Telemetry fields of documents that came through a collector."""
    sdk = F.struct(
        F.lit("opentelemetry").alias("name"),
        F.lit("go").alias("language"),
        F.lit(SDK_VERSION).alias("version"),
    )
    distro = F.struct(F.lit("elastic").alias("name"), F.lit(AGENT_VERSION).alias("version"))
    return F.when(source == "otel", F.struct(sdk.alias("sdk"), distro.alias("distro")))


def normalise_category(value: Column, data_type) -> Column:
    """A list of strings, whether the document held a list or a bare string."""
    if isinstance(data_type, ArrayType):
        return value.cast("array<string>")
    if isinstance(data_type, VariantType):
        scalar = F.try_variant_get(value, "$", "string")
        return F.when(
            F.schema_of_variant(value).startswith("ARRAY"),
            F.try_variant_get(value, "$", "array<string>"),
        ).otherwise(X.as_list(scalar))
    return X.as_list(value.cast("string"))


def _leaf(df: DataFrame, root: str, leaf: str, kind: str = "string") -> Column:
    if root in df.columns:
        body = df.schema[root].dataType
        if isinstance(body, StructType) and leaf in body.names:
            return F.col(root)[leaf].cast(kind)
        if isinstance(body, VariantType):
            return F.try_variant_get(F.col(root), f"$.{leaf}", kind)
    return F.lit(None).cast(kind)


def enrich(
    df: DataFrame, event_type: str, key: str, service: str = "service_id", override: str | None = None
) -> DataFrame:
    """All of the above over documents with ``ts``, a service column and a unique key.

    What the document already says is kept, field by field in ``event``, ``log``, ``host`` and
    ``service``, and as whole blocks elsewhere. The contexts that go below ``aws`` come out as
    ``aws_context``, taken from the document where it has them; the ``aws`` tail itself is left as it
    is, so that its VARIANT is not rebuilt row by row.
    """
    svc, ts = F.col(service), F.col("ts")
    # Looked up and hashed once per row, in a projection of their own.
    df = df.withColumns(
        {
            "_digest": F.sha1(F.col(key).cast("string")),
            "ingest_source": R.resolve_source(svc, F.col(override) if override else None),
            "_region": F.coalesce(F.col("cloud.region"), F.lit(DEFAULT_REGION)),
            "_account": F.coalesce(F.col("cloud.account.id"), F.lit(DEFAULT_ACCOUNT)),
            "_resolved": R.resolve_dataset(svc, event_type),
        }
    )
    digest, source = F.col("_digest"), F.col("ingest_source")
    region, account, resolved = F.col("_region"), F.col("_account"), F.col("_resolved")

    def given(root: str) -> Column | None:
        return F.col(root) if root in df.columns else None

    stream = F.struct(
        F.lit(event_type).alias("type"),
        resolved.alias("dataset"),
        F.lit("default").alias("namespace"),
    )
    module, dataset = event_defaults(
        _leaf(df, "event", "module"), _leaf(df, "event", "dataset"), resolved
    )
    columns: dict[str, Column] = {
        "ecs": F.coalesce(given("ecs"), F.struct(F.lit(SCHEMA_VERSION).alias("version")))
        if given("ecs") is not None
        else F.struct(F.lit(SCHEMA_VERSION).alias("version")),
        "data_stream": F.coalesce(given("data_stream"), stream)
        if given("data_stream") is not None
        else stream,
        "event": fill_struct(df, "event", {"module": module, "dataset": dataset}),
        "input": F.coalesce(
            *([given("input")] if given("input") is not None else []),
            F.struct(
                R.input_type(F.lit("otel") if event_type == "traces" else source).alias("type")
            ),
        ),
    }
    columns["agent"] = whole_or(df, "agent", agent_block(source, event_type, region, digest))
    if event_type == "logs":
        named = service_block(svc, _leaf(df, "service", "name"), _leaf(df, "service", "type"))
        columns["service"] = with_leaves(df, "service", {n: named[n] for n in ("name", "type")})
        columns["log"] = with_leaves(df, "log", {"level": log_level(_leaf(df, "log", "level"))})
        host = host_block(svc, digest, _leaf(df, "host", "name"), _leaf(df, "host", "hostname"))
        columns["host"] = with_leaves(df, "host", {n: host[n] for n in ("name", "hostname")})
        made_otel = otel_block(source)
        columns["telemetry"] = (
            made_otel if given("telemetry") is None else F.coalesce(given("telemetry"), made_otel)
        )
        columns["aws_context"] = F.struct(
            own_context(df, "s3", s3_context(svc, account, region, ts, digest)).alias("s3"),
            own_context(df, "cloudwatch", cloudwatch_context(svc, region, ts, digest)).alias("cloudwatch"),
            own_context(df, "firehose", firehose_context(source, svc, region, account, digest)).alias(
                "firehose"
            ),
        )
    return df.withColumns(columns).drop("_digest", "_region", "_account", "_resolved")

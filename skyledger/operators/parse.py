"""Parsing of the message field: JSON, renames, grok patterns and line formats."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.scalars import strict_json, strict_json_list

# The grok pattern names in use and the expressions they stand for.
GROK_PATTERNS = {"DATA": r".*?", "NUMBER": r"[+-]?[0-9]+(?:\.[0-9]+)?|[+-]?\.[0-9]+"}
GROK_TYPES = {"float": "double", "int": "bigint", "": "string"}
VENDOR = "aws."
_GROK_SLOT = re.compile(r"%\{(\w+)(?::([\w.]+))?(?::(\w+))?\}")


def json_value(message: Column) -> Column:
    """Any JSON value as VARIANT; text that is no JSON gives NULL and the row stays."""
    return strict_json(message)


def rename_into(target: Column | None, source: Column, on_conflict: str = "keep_target") -> Column:
    """Move a field. A target that is set wins unless ``on_conflict='overwrite'``."""
    if target is None:
        return source
    if on_conflict == "overwrite":
        return F.coalesce(source, target)
    return F.coalesce(target, source)


def lowercase(value: Column) -> Column:
    """P3."""
    return F.lower(value)


@dataclass(frozen=True)
class Grok:
    """One grok pattern as a regular expression with its named, typed captures."""

    regex: str
    captures: tuple[tuple[str, str], ...]


def grok_pattern(pattern: str) -> Grok:
    """Translate ``%{NAME:field:type}`` slots. A trailing lazy slot takes the empty text."""
    captures: list[tuple[str, str]] = []

    def slot(m: re.Match) -> str:
        body = GROK_PATTERNS[m.group(1)]
        if m.group(2) is None:
            return f"(?:{body})"
        captures.append((m.group(2), GROK_TYPES[m.group(3) or ""]))
        return f"({body})"

    return Grok(_GROK_SLOT.sub(slot, pattern), tuple(captures))


def grok(message: Column, patterns: list[str]) -> dict[str, Column]:
    """The first pattern that matches fills its captures; others stay NULL."""
    compiled = [grok_pattern(p) for p in patterns]
    names: dict[str, str] = {}
    for g in compiled:
        names.update(dict(g.captures))
    out = {}
    for name, kind in names.items():
        chosen = F.lit(None).cast(kind)
        for g in reversed(compiled):
            group = next((i + 1 for i, (n, _) in enumerate(g.captures) if n == name), None)
            got = (
                F.regexp_extract(message, g.regex, group).try_cast(kind)
                if group
                else F.lit(None).cast(kind)
            )
            chosen = F.when(message.rlike(g.regex), got).otherwise(chosen)
        out[name] = chosen
    return out


@dataclass(frozen=True)
class Parser:
    """What to do with the messages of one dataset.

    ``renames`` are (key below the parsed JSON, target field); ``lower`` are target fields to
    lower-case after renaming; ``groks`` are patterns tried before the JSON parse.
    """

    dataset: str
    group: str
    namespace: str
    renames: tuple[tuple[str, str], ...] = ()
    lower: tuple[str, ...] = ()
    groks: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"logs-{self.dataset}-default"


def parse_documents(
    df: DataFrame,
    parsers: list[Parser],
    dataset: str = "dataset",
    message: str = "message",
    existing: dict[str, str] | None = None,
    on_conflict: str = "keep_target",
) -> DataFrame:
    """One projection for all datasets.

    Adds ``parsed_as`` (the namespace the JSON goes to), ``parsed`` (VARIANT, NULL for plain
    text) and one column per target field used by the chosen parsers, dots replaced by ``__``.
    ``existing`` maps target fields such as ``log.level`` to columns that may already hold them.
    Datasets without a parser pass through. The message is parsed once per row; fields are taken from that
    parse, without a copy of its value.
    """
    existing = existing or {}
    text, ds = F.col(message), F.col(dataset)
    out = df.withColumn("parsed_as", _namespace(ds, parsers))
    out = out.withColumn("_list", F.when(F.col("parsed_as").isNotNull(), strict_json_list(text)))
    out = out.withColumn("parsed", F.try_variant_get("_list", "$[0]", "variant"))

    moved: dict[str, Column] = {}
    for p in parsers:
        for key, target in p.renames:
            value = F.try_variant_get(F.col("_list"), f"$[0].{key}", "string")
            moved[target] = F.when(ds == p.dataset, value).otherwise(
                moved.get(target, F.lit(None).cast("string"))
            )
        for target, value in grok(text, list(p.groks)).items():
            before = moved.get(target)
            hit = F.when(ds == p.dataset, value)
            moved[target] = hit if before is None else hit.otherwise(before)
    lowered = {t: [p.dataset for p in parsers if t in p.lower] for p in parsers for t in p.lower}
    columns = {}
    for target, value in moved.items():
        present = F.col(existing[target]) if target in existing else None
        result = rename_into(present, value, on_conflict)
        if target in lowered:
            result = F.when(ds.isin(*lowered[target]), lowercase(result)).otherwise(result)
        columns[target.replace(".", "__")] = result
    return out.withColumns(columns).drop("_list")


def _namespace(dataset: Column, parsers: list[Parser]) -> Column:
    """The namespace of a dataset's parser. Most are the dataset without its vendor; a set finds those at once,
    where a map is searched from its start for every row."""
    plain = [p.dataset for p in parsers if p.namespace == f"{p.dataset.removeprefix(VENDOR)}.parsed"
             and p.dataset.startswith(VENDOR)]
    out = F.when(dataset.isin(plain), F.concat(F.substr(dataset, F.lit(len(VENDOR) + 1)), F.lit(".parsed")))
    for p in parsers:
        if p.dataset not in plain:
            out = out.when(dataset == p.dataset, p.namespace)
    return out


def flow_record(message: Column) -> Column:
    """A version 2 flow log line as a struct of 14 fields; other lines give NULL."""
    part = F.split(message, " ")
    # Field order and types of the line.
    layout = [
        ("version", "int"), ("account_id", "string"), ("interface_id", "string"),
        ("srcaddr", "string"), ("dstaddr", "string"), ("srcport", "int"), ("dstport", "int"),
        ("protocol", "int"), ("packets", "bigint"), ("bytes", "bigint"), ("start", "bigint"),
        ("end", "bigint"), ("action", "string"), ("log_status", "string"),
    ]
    fields = [
        F.nullif(F.get(part, F.lit(i)), F.lit("-")).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(layout)
    ]
    return F.when((F.size(part) == 14) & (F.get(part, F.lit(0)) == "2"), F.struct(*fields))


def function_app_line(message: Column) -> Column:
    """``[LEVEL]<tab>request id<tab>text``."""
    regex = r"^\[([A-Z]+)\]\t([^\t]+)\t(.*)$"
    return F.when(
        message.rlike(regex),
        F.struct(
            F.lower(F.regexp_extract(message, regex, 1)).alias("level"),
            F.regexp_extract(message, regex, 2).alias("request_id"),
            F.regexp_extract(message, regex, 3).alias("text"),
        ),
    )


def init_duration(message: Column) -> Column:
    """P10: cold-start time in ms, NULL when the line has none."""
    return F.nullif(
        F.regexp_extract(message, r"Init Duration: ([0-9.]+) ms", 1), F.lit("")
    ).try_cast("double")


def dns_query_line(message: Column) -> Column:
    """Time, query id, address family, source, port, record type, name, response code."""
    part = F.split(message, " ")
    layout = [
        ("query_time", "string"), ("query_id", "string"), ("family", "string"),
        ("srcaddr", "string"), ("srcport", "int"), ("record_type", "string"),
        ("name", "string"), ("response_code", "string"),
    ]
    fields = []
    for i, (name, kind) in enumerate(layout):
        value = F.get(part, F.lit(i))
        if name == "name":
            value = F.regexp_replace(value, r"\.$", "")
        fields.append(value.try_cast(kind).alias(name))
    return F.when(F.size(part) == 8, F.struct(*fields))


def http_access_line(message: Column) -> Column:
    """``METHOD path status 12ms`` and ``METHOD path status [edge]``."""
    regex = r"^([A-Z]+) (\S+) ([0-9]{3}) (?:([0-9]+)ms|\[([^\]]*)\])$"
    got = lambda i: F.nullif(F.regexp_extract(message, regex, i), F.lit(""))
    return F.when(
        message.rlike(regex),
        F.struct(
            got(1).alias("method"),
            got(2).alias("path"),
            got(3).cast("int").alias("status"),
            got(4).cast("bigint").alias("millis"),
            got(5).alias("edge"),
        ),
    )


def embedded_json(text: Column) -> Column:
    """JSON kept as text inside a field; the literal text ``null`` counts as missing."""
    return F.when(F.trim(text) != "null", strict_json(text))


def parse_coverage(df: DataFrame, dataset: str = "dataset", parsed: str = "parsed") -> DataFrame:
    """Rows and share of rows with parsed JSON, per dataset."""
    return df.groupBy(dataset).agg(
        F.count("*").alias("docs"),
        F.avg(F.col(parsed).isNotNull().cast("double")).alias("parsed_share"),
    )

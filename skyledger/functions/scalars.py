"""Scalar expressions shared by the operators. Everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: protocol numbers and names seen in flow records.
PROTOCOL_NAMES = {6: "tcp", 17: "udp", 1: "icmp"}

BYTES_PER_MB = 1024**2
BYTES_PER_GB = 1024**3


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text that is no timestamp gives NULL."""
    return text.try_cast("timestamp")


def plus_millis(ts: Column, millis: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + millis.cast("bigint") * 1000)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("bigint"))


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint"))


def to_epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def to_epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def ns_to_s(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1e9)


def us_to_ms(us: Column) -> Column:
    return us.cast("double") / F.lit(1e3)


def ms_to_s(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1e3)


def bytes_to_mb(n: Column) -> Column:
    return n.cast("double") / F.lit(float(BYTES_PER_MB))


def bytes_to_gb(n: Column) -> Column:
    return n.cast("double") / F.lit(float(BYTES_PER_GB))


def round_places(x: Column, places: int) -> Column:
    return F.round(x, places)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def billed_millis(duration_ms: Column) -> Column:
    """Duration rounded up to the next full 100 ms."""
    return (F.ceil(duration_ms / 100) * 100).cast("bigint")


def strip_vendor(dataset: Column) -> Column:
    return F.regexp_replace(dataset, r"^aws\.", "")


def protocol_name(number: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.lit("tcp"))


def flow_outcome(action: Column) -> Column:
    return F.when(F.upper(action) == "ACCEPT", "success").otherwise("failure")


def flow_level(action: Column) -> Column:
    return F.when(F.upper(action) == "REJECT", "warn").otherwise("info")


def severity_label(code: Column) -> Column:
    return F.when(code >= 8, "CRITICAL").when(code >= 7, "HIGH").otherwise("MEDIUM")


def status_class(status: Column) -> Column:
    return F.floor(status / 100).cast("int")


def is_client_error(status: Column) -> Column:
    return status_class(status) == 4


def is_server_error(status: Column) -> Column:
    return status_class(status) == 5


def arn(service: Column, region: Column, account: Column, resource: Column) -> Column:
    return F.concat_ws(":", F.lit("arn"), F.lit("aws"), service, region, account, resource)


def arn_part(value: Column, position: int) -> Column:
    """Part of an ARN, 1-based; the resource (part 6) keeps its own colons."""
    return F.try_element_at(F.split(value, ":", 6), F.lit(position))


def last_segment(value: Column) -> Column:
    return F.element_at(F.split(value, "/"), -1)


# First and last character of something that may be JSON; settles most plain lines cheaply.
_JSON_SHAPE = (
    r"""(?s)^\s*(?:\{.*\}|\[.*\]|".*"|true|false|null|-?[0-9][0-9.eE+-]*)\s*$"""
)


def _json_shape(text: Column) -> Column:
    """Whether the text has that shape; one in bare braces or brackets is told by its ends, without reading it."""
    ends = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))
    return ends | text.rlike(_JSON_SHAPE)


def strict_json_list(text: Column) -> Column:
    """A VARIANT list of the text alone if it is one JSON value and nothing else, NULL otherwise.

    The built-in parser stops after the first value, so a flow record such as ``2 1234 eni-1``
    would pass as the number 2. Text after the value has to be legal inside a list and inside an
    object at the same time to get through here, and no such text exists.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(_json_shape(text) & keyed.isNotNull(), listed)


def strict_json(text: Column) -> Column:
    """The text as VARIANT if it is one JSON value and nothing else, NULL otherwise."""
    return F.try_variant_get(strict_json_list(text), "$[0]", "variant")


def json_field(text: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(strict_json(text), path, as_type)


def as_list(value: Column) -> Column:
    """Wrap a scalar in an array; NULL stays NULL."""
    return F.when(value.isNotNull(), F.array(value))


def dimension(dimensions: Column, key: str) -> Column:
    return F.try_element_at(dimensions, F.lit(key))


def name_uuid(seed: Column) -> Column:
    """A repeatable UUID: SHA-1 of the seed shaped with the version and variant digits."""
    return digest_uuid(F.sha1(seed))


def digest_uuid(digest: Column) -> Column:
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )


def name_digest(name: Column) -> Column:
    return F.sha2(name, 256)


def duration_is_valid(duration: Column) -> Column:
    return F.coalesce(duration > 0, F.lit(False))


def label_number(labels: Column, key: str, as_type: str = "bigint") -> Column:
    """A number kept as text in a label map."""
    return F.try_element_at(labels, F.lit(key)).try_cast(as_type)

"""Field access by dotted name: typed columns first, the VARIANT tail otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType


def variant_path(keys: Sequence[str]) -> str:
    """A VARIANT path whose keys may hold dots and spaces."""
    return "$" + "".join("['{}']".format(k) for k in keys)


def promoted_name(path: str) -> str:
    """Column name of a field that was promoted out of the VARIANT tail."""
    return path.replace(".", "__")


def promote(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Typed copies of hot fields (``{path: type}``), to be added before a table is written.

    A VARIANT is read whole, whatever is asked of it; a promoted column is read alone, and
    filters on it reach the Parquet scan. ``pick`` prefers promoted columns.
    """
    return df.withColumns({promoted_name(p): pick(df, p, kind) for p, kind in paths.items()})


def pick(df: DataFrame, path: str | Sequence[str], as_type: str = "string") -> Column:
    """The column for a field name such as ``aws.glue.job.name``.

    Typed struct columns are used directly, so that column pruning reaches the scan; the rest
    of the name is looked up inside a VARIANT column. Names whose keys hold dots are given as a
    list of keys. A name found nowhere is NULL, as in a schemaless store.
    """
    keys = path.split(".") if isinstance(path, str) else list(path)
    for name in (path, promoted_name(path)) if isinstance(path, str) else ():
        if name in df.columns:
            return F.col(f"`{name}`").cast(as_type)
    node, column = df.schema, None
    for i, key in enumerate(keys):
        if isinstance(node, VariantType):
            return F.try_variant_get(column, variant_path(keys[i:]), as_type)
        if not isinstance(node, StructType) or key not in node.names:
            return F.lit(None).cast(as_type)
        column = F.col(f"`{key}`") if column is None else column.getField(key)
        node = node[key].dataType
    return column.cast(as_type)

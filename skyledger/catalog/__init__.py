"""All registered queries. Importing a module registers its plans."""

from skyledger.catalog import (  # noqa: F401
    detection,
    documents,
    metrics,
    panels,
    parsing,
    quality,
    security,
    stats,
    streams,
    traces,
)
from skyledger.catalog.base import ORACLE, QUERIES  # noqa: F401

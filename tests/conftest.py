from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from skyledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="tests", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def rows(spark):
    """Small DataFrames from literal rows."""

    def make(data, ddl):
        return spark.createDataFrame(data, ddl)

    return make

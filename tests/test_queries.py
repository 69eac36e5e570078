"""Every registered query against its reference SQL on the smallest data."""

from __future__ import annotations

import pytest

from palimpsest.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Long-running streams; tests/check.py runs them all on any data.
SLOW = {"stream_capture_corpus"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None
    else:
        QUERIES[name](spark, SF).collect()

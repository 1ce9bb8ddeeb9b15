"""Every registered query against its SQL, over the whole small data set."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import parity

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    if name in SQL:
        assert parity.compare(spark, duck, SF_DIR, name, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() >= 0


def test_entry(spark):
    assert "ring_id" in entry.entry(spark).columns

"""Every registered query against its SQL on the smallest driver data."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    same, message = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert same, message


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "deviation" in frame.columns
    assert set(ORACLES) <= set(QUERIES)

"""Every registered query against its SQL twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

duckdb = pytest.importorskip("duckdb")

from compare import TABLES, compare

from pagelake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for table in TABLES:
        found.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return found


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, connection, name):
    outcome, _ = compare(spark, connection, SF, name)
    assert outcome.startswith(("equal", "rows")), outcome

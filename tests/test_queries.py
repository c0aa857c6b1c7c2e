"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import assert_equal, connect

from quirewise.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert_equal(QUERIES[name](spark, SF), db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    made = QUERIES[name](spark, SF)
    rows = made.collect()
    assert rows and len(rows[0]) == len(made.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the reference's operators against its SQL, on the smallest tables."""

import os

import pytest

from gridloom.plans import QUERIES, SQL

from .oracle import DATA, connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

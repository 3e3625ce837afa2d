import os

import pytest

from gridloom.llm.queries import QUERIES, SQL
from tests.oracle import DATA, connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == []

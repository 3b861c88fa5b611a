"""Every registered query with a SQL counterpart, on the smallest given tables."""

import os

import pytest
from compare import connect, differences

from catalog.all_queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection, SQL[name]) == ""

"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from emberline.oracle import ORACLE_SQL
from emberline.queries import QUERIES
from tests.oracles import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0

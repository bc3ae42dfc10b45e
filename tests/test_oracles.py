import pytest

from glyphstream.plans.queries import QUERIES, SQL

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, name, QUERIES[name], SQL[name], SF)


def test_queries_without_sql(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0

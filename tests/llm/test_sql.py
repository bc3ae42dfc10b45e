"""The corpus queries that have SQL equal it over whole tables."""

import pytest

from glyphstream.llm.queries import QUERIES, SQL

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF) > 0

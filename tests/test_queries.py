"""Registered queries against their SQL on the smallest tables."""

import pytest
from compare import compare, duck

from wardspark.plans.oracles import oracles
from wardspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracles()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    got, want = compare(spark, duck(SF), SF, QUERIES[name], SQL[name])
    assert got == want

"""Queries of the training-data operators that have SQL, against it."""

import pytest
from tests.oracle import compare, connect

from driftspark.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, connect(D), queries.queries()[name], queries.oracle_sql()[name], D) is None

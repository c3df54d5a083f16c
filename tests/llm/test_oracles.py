"""Queries of the subpackage against their SQL on the smallest tables."""

import pytest

from conftest import same_as_sql
from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, name, queries.queries(), queries.oracle_sql())


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))

"""Queries against their SQL, over a whole small table."""

import pytest

from tests.llm import duck
from vesper.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, name):
    assert duck.frame_rows(queries.queries()[name](spark, SF)) == duck.rows(queries.oracle_sql()[name], SF)


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]

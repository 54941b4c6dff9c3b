import pytest

from siltstone.llm.queries import QUERIES
from siltstone.llm.sql import SQL
from tests.conftest import SMALL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert compare(spark, SMALL, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

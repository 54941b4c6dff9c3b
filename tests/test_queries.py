import pytest

from siltstone.queries import QUERIES, SQL
from tests.conftest import LARGE, SMALL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert compare(spark, SMALL, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    """Queries that SQL can't express give rows on the test tables, each once; their operators have tests of their own."""
    df = QUERIES[name](spark, LARGE)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

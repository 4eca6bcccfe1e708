import pytest

from quern.plans.registry import QUERIES, SQL
from tests.oracle import DATA, compare

WITHOUT_SQL = {"dense_latent", "html_sections"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_every_query_has_sql_but_those_that_cannot():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_queries_without_sql_run(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

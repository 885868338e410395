import pytest

from skosloom.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, sf, name):
    assert_same(spark, sf, catalog.QUERIES[name], catalog.ORACLE[name])


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_others_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SMALL).limit(1).count() == 1

"""Every registered query of the library against its SQL."""

import pytest

from tests.compare import SMALL, difference
from vintagelake.plans.registry import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns

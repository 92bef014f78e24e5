"""Every registered query of the library against its oracle, over the smallest tables."""

import pytest
from conftest import SMALL
from oracle import check

from lectern import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, name):
    check(plans.QUERIES[name](spark, SMALL), plans.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

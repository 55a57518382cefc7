"""Every core query with SQL against DuckDB, the others for running at all."""

import pytest

from docweave import queries as core
from tests.oracle import compare

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    compare(spark, small, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert core.queries()[name](spark, small).count() >= 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4

"""The queries of the subpackage on the small test tables."""

import pytest

from docweave.llm import queries as llm
from tests.oracle import compare

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    compare(spark, small, llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert llm.queries()[name](spark, small).count() > 0

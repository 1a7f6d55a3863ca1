"""Every query of the core against its SQL on the smallest dataset; those without SQL must run and give a stable schema."""

import pytest

from glyphloom.plans.registry import ORACLES, QUERIES
from tests.parity import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    assert differences(spark, folder, QUERIES[name], ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0

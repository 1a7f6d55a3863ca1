"""Every query of the subpackage on the smallest dataset, against its SQL where it has one."""

import pytest

from glyphloom.llm.oracles import ORACLES
from glyphloom.llm.queries import QUERIES
from tests.parity import differences

FOUND = {
    1: {"record_kind", "record_id"},
    2: {"record_kind", "record_id", "noise_kind"},
    3: {"record_kind", "record_id", "text_shape"},
    4: {"frame_id_a", "frame_id_b"},
    5: {"stats_id"},
    6: {"record_kind", "record_id", "language"},
    7: {"record_kind", "record_id", "line_number"},
    8: {"spec_id", "doc_id"},
    9: {"mix_id", "source"},
    10: {"spec_id", "doc_id"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    assert differences(spark, folder, QUERIES[name], ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


@pytest.mark.parametrize("n", sorted(FOUND))
def test_columns_of_found(spark, folder, n):
    df = QUERIES[f"p{n}_found"](spark, folder)
    assert set(df.columns) == FOUND[n] and df.count() == df.distinct().count()

import pytest
from oracle import DATA, compare

from siltstone.llm import queries

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize(("name", "columns"), [("p6_found", "string_id_a string_id_b"), ("p7_ids", "doc_id ids"), ("p9_found", "doc_id subject"), ("p8_mix", "doc_id source n_tokens repeats"), ("p4_splits", "pair_id grp group_rows split")])
def test_columns(spark, name, columns):
    found = queries.QUERIES[name](spark, str(DATA))
    assert found.columns == columns.split() and found.count() > 0

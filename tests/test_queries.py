import pytest
from oracle import DATA, compare

from siltstone.plans import catalogue

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    found = catalogue.QUERIES[name](spark, str(DATA))
    assert len(found.columns) > 1 and found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

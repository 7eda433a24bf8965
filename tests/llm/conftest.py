import pytest


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples)."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)

"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from catalog import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# The optional queries have tests of their own.
QUERIES = {n: entry.queries()[n] for n in registry.QUERIES}
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        # Single ids and narrow filters may find nothing at this scale.
        problem = compare(df, duck.sql(ORACLES[name]).to_arrow_table(), allow_empty=True)
        assert problem is None
    else:
        assert df.count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["day", "platform", "n_posts"]
    assert df.count() > 0

import pytest

from framesleuth.plans.catalog import oracle_sql, queries
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    if not len(want):
        assert not len(got) and sorted(got.columns) == sorted(want.columns)
        return
    assert compare(got, want) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0

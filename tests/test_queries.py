import pytest

import __spark_entry__ as contract
from flowtusk.checks.compare import connect, difference


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None

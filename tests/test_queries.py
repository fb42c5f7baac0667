"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from tests.conftest import SMALL

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    ok, note = compare(spark, connection, SMALL, entry.queries()[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 6000

"""Every query equals its SQL on the smallest sample."""

import pytest

from checks.local import compare, duck
from checks.oracle import oracle_sql
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, _, _, note = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert ok, note

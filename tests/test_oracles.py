"""Every registered query equals its SQL twin on the small tables."""

import pytest

from tapeloom.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    columns, names, ours, theirs = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert columns == names
    assert ours == theirs
    assert ours

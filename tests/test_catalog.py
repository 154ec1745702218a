"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import catalog.all  # noqa: F401
from catalog.registry import QUERIES, SQL
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# The smallest tables leave no stretch without spikes, so fits without SQL run one size up.
SF_ROWS = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    if name in SQL:
        result = QUERIES[name](spark, SF)
        same, message = compare(result, tables, SQL[name])
        assert same, message
    else:
        assert QUERIES[name](spark, SF_ROWS).count() > 0

"""Every registered operator with SQL against its independent DuckDB statement."""

import pytest

from attrition.plans.oracle import SQL
from attrition.plans.registry import QUERIES
from attrition.plans.verify import compare, duckdb_connection

from conftest import SF_SMALL

ORACLE_KEYS = sorted(k for k in QUERIES if k in SQL)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(QUERIES[key](spark, SF_SMALL), con, SQL[key])
    assert r["match"], r

"""Every catalog query against its DuckDB oracle (the driver's gate), on the
smallest scale; set QANAT_TEST_SF to run another scale."""

import os

import pytest

from qanat.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

SF = os.environ.get("QANAT_TEST_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    problems, _ = compare(spark, key, QUERIES[key], ORACLES[key], SF, con)
    assert not problems, problems


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_non_sql_runs(spark, key):
    assert QUERIES[key](spark, SF).count() >= 0


def test_every_key_has_a_callable():
    assert len(QUERIES) >= 80
    assert set(ORACLES) <= set(QUERIES)

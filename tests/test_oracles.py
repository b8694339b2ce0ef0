"""Every registered query against its SQL."""

import __spark_entry__ as entry_point
import pytest
from compare import connect, differences

from claimflow.plans.oracles import ORACLES
from claimflow.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    with connect(sf_dir) as connection:
        yield connection


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf_dir, con):
    assert differences(name, QUERIES[name], ORACLES[name], spark, sf_dir, con) is None


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 1 and rows[0].total_claims == 1500

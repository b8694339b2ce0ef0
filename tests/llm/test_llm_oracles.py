"""The training-data queries that SQL can express, against it."""

import pytest
from compare import connect, differences

from claimflow.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir):
    with connect(sf_dir) as con:
        assert differences(name, QUERIES[name], ORACLES[name], spark, sf_dir, con) is None

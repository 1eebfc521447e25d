"""Every query with an oracle against DuckDB on the smallest tables."""

import pytest
from conftest import SF
from util import assert_same

import setloom.plans.catalog  # noqa: F401
from setloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert_same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])

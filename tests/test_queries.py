"""Every registered query against its SQL."""

import pytest

from pricemill.registry import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert name in ORACLES
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""

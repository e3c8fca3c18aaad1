"""Every registered SQL against its Spark query on the smallest tables."""

import pytest

from verification import catalog
from verification.compare import compare, connect

SF = "/root/testdata/sf0.001"
catalog.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_rows(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", ["ols_summary", "ols_summary_orders"])
def test_statistics_on_more_rows(spark, name):
    """Probabilities far below the smallest double occur from some thousand rows on."""
    sf = "/root/testdata/sf0.01"
    assert compare(catalog.QUERIES[name](spark, sf), connect(sf), catalog.ORACLES[name]) is None

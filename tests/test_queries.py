"""Every registered query runs on the test tables and equals its check SQL."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# With about a hundred baskets per tenant, a support of 1 % is a single basket and every subset of
# every basket is frequent; the brand rules are checked where the threshold means something.
BRAND_RULES = {
    "basket_rules_resolved", "basket_signals", "recommendations", "recommendations_older", "recommendation_list",
    "recommendation_summary", "customers_with_recommendations", "customer_recommendations",
}


@pytest.fixture(scope="module")
def ducks():
    return {sf: connect(sf) for sf in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, ducks, name):
    sf = LARGER if name in BRAND_RULES else SMALL
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert differences(df, ducks[sf], sql) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Rules and recommendations of actual products against plain counting and brute force over all products."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from test_basket import plain_rules, plain_sets
from test_closed import basis, implied
from test_recommend import brute
from tillwater.operators import basket, recommend
from tillwater.plans.baskets import PRODUCT_SUPPORT
from tillwater.sources.testdata import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rules(spark):
    out = defaultdict(dict)
    for r in entry.queries()["product_association_rules"](spark, SMALL).collect():
        key = tuple(r["antecedent"].split("|")), tuple(r["consequent"].split("|"))
        assert key not in out[r["user_id"]]
        out[r["user_id"]][key] = (r["support"], r["confidence"], r["lift"])
    return out


def test_product_rules(spark, rules):
    t = Tables(spark, SMALL)
    done = {r["order_id"]: r["user_id"] for r in t.completed.collect()}
    lines = defaultdict(lambda: defaultdict(set))
    for r in t.order_items.collect():
        if r["order_id"] in done:
            lines[done[r["order_id"]]][r["order_id"]].add(str(r["product_id"]))
    assert sum(len(x) for x in rules.values()) > 0
    for u, baskets in lines.items():
        sets = plain_sets(list(baskets.values()), max(2 / len(baskets), PRODUCT_SUPPORT))
        want = basis(sets, len(baskets), basket.MIN_CONFIDENCE)
        assert set(rules[u]) == set(want)
        # All rules between products follow from these.
        assert all(implied(k, v, want) for k, v in plain_rules(sets, len(baskets), basket.MIN_CONFIDENCE).items())
        assert all(abs(x - y) <= 5.1e-5 for k in want for x, y in zip(rules[u][k], want[k]))


def test_product_recommendations(spark, rules):
    t = Tables(spark, SMALL)
    customers, history, got = defaultdict(list), defaultdict(list), defaultdict(dict)
    for r in t.tenant_of.collect():
        customers[r["user_id"]].append(r["customer_id"])
    for r in recommend.purchases(t.completed, t.order_items).collect():
        history[r["user_id"]].append((r["customer_id"], r["product_id"]))
    products = {r["product_id"]: (r["name"], r["category"]) for r in t.catalogue.collect()}
    rows = entry.queries()["recommendations_products"](spark, SMALL).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["user_id"]].setdefault(r["customer_id"], []).append((r["product_id"], r["score"]))
    assert any(r["reason"].startswith("Frequently purchased with") for r in rows)
    for u in customers:
        own = [([int(x) for x in a], [int(x) for x in c], *v) for (a, c), v in rules[u].items()]
        want = brute(customers[u], products, history[u], own, recommend.V23)
        for c in customers[u]:
            mine = got[u].get(c, [])
            assert [p for p, _ in mine] == [p for p, _ in want[c]], (u, c)
            assert all(abs(a[1] - b[1]) < 2e-4 for a, b in zip(mine, want[c]))

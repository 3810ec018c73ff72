"""Itemsets and rules against plain counting and the four-product demo."""

import itertools
import random
from collections import Counter

import pytest

from tillwater.operators import basket

DEMO = ["L", "M", "K", "N", "M", "LM", "KL", "KM", "MN", "KML"]


def frame(spark, baskets):
    rows = [(u, f"o{i}", sorted(set(b))) for u, bs in baskets.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "user_id string, order_id string, items array<string>")


def plain_sets(bs, s):
    counts = Counter(c for b in bs for k in range(1, len(set(b)) + 1) for c in itertools.combinations(sorted(set(b)), k))
    return {k: n for k, n in counts.items() if n / len(bs) >= s}


def plain_rules(sets, n, conf):
    out = {}
    for items, c in sets.items():
        for k in range(1, len(items)):
            for a in itertools.combinations(items, k):
                b = tuple(x for x in items if x not in a)
                if c / sets[a] >= conf:
                    out[(a, b)] = (c / n, c / sets[a], c / sets[a] / (sets[b] / n))
    return out


def check(spark, baskets, s, conf):
    sets = basket.frequent_itemsets(frame(spark, baskets), s)
    got = {(r["user_id"], tuple(r["items"])): r["item_count"] for r in sets.collect()}
    want = {(u, k): n for u, bs in baskets.items() for k, n in plain_sets(bs, s).items()}
    assert got == want
    rules = {(r["user_id"], tuple(r["antecedent"]), tuple(r["consequent"])): r for r in basket.association_rules(sets, conf).collect()}
    want_rules = {(u, *k): v for u, bs in baskets.items() for k, v in plain_rules(plain_sets(bs, s), len(bs), conf).items()}
    assert set(rules) == set(want_rules)
    for k, (support, confidence, lift) in want_rules.items():
        for c, v in (("support", support), ("confidence", confidence), ("lift", lift)):
            assert abs(rules[k][c] - v) <= 5.1e-5


def test_demo(spark):
    tx = frame(spark, {"u": DEMO})
    sets = basket.frequent_itemsets(tx)
    rules = basket.association_rules(sets)
    s = basket.summary(tx, sets, rules).collect()[0]
    assert (s["transactions"], s["products"], s["itemsets"], s["rules"]) == (10, 4, 9, 10)
    assert (s["average_confidence"], s["max_lift"], s["top_antecedent"], s["top_consequent"]) == (0.4667, 1.25, ["K"], ["L"])
    wide = {(tuple(r["antecedent"]), tuple(r["consequent"])): r["confidence"] for r in basket.association_rules(sets, 0.16).collect()}
    assert wide[(("K",), ("L", "M"))] == 0.25 and wide[(("M",), ("K", "L"))] == 0.1667


def test_against_plain_counting(spark):
    rnd = random.Random(3)
    make = lambda n, p: ["".join(x for x in "abcdefg" if rnd.random() < p) or "a" for _ in range(n)]
    # Tenants of very different size are mined together.
    check(spark, {"big": make(300, 0.3), "mid": make(40, 0.4), "also": make(33, 0.2), "one": ["ab"]}, 0.05, 0.30)


def test_support_on_the_edge(spark):
    # 7 of 100 baskets at support 0.07: in doubles 0.07 * 100 exceeds 7.
    check(spark, {"u": ["ab"] * 7 + ["c"] * 93}, 0.07, 0.5)


def test_transactions(spark):
    items = spark.createDataFrame(
        [("o1", " a "), ("o1", "a"), ("o1", "b"), ("o2", " "), ("o3", "c"), ("o4", "a")], "order_id string, product_id string"
    )
    orders = spark.createDataFrame(
        [("u", "o1", "completed"), ("u", "o2", "completed"), ("u", "o3", "Completed"), ("v", "o4", "completed")],
        "user_id string, order_id string, status string",
    )
    got = [tuple(r) for r in basket.transactions(items, orders).collect()]
    assert got == [("u", "o1", ["a", "b"])]  # v has a single product, o3 another spelling of the status
    empty = basket.frequent_itemsets(basket.transactions(items, orders.filter("false")))
    assert empty.count() == 0 and basket.association_rules(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_support_is_monotone(spark, seed):
    rnd = random.Random(seed)
    bs = ["".join(x for x in "abcde" if rnd.random() < 0.5) or "e" for _ in range(60)]
    sets = {tuple(r["items"]): r["support"] for r in basket.frequent_itemsets(frame(spark, {"u": bs}), 0.02).collect()}
    for items, s in sets.items():
        for x in itertools.combinations(items, len(items) - 1):
            assert not x or sets[x] >= s

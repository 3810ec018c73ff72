"""Closed itemsets, their generators and rules against plain counting."""

import itertools
import random

import pytest

from test_basket import frame, plain_rules, plain_sets
from tillwater.operators import basket, closed
from tillwater.operators.containment import holders


def plain_generators(sets):
    """Generator to (closed set, count), from all frequent sets."""
    out = {}
    for items, n in sets.items():
        if not any(sets[p] == n for k in range(1, len(items)) for p in itertools.combinations(items, k)):
            larger = [s for s, m in sets.items() if m == n and set(items) <= set(s)]
            out[items] = (max(larger, key=len), n)
    return out


def basis(sets, n, confidence):
    """The rules of all that start at a generator and end at a closed set."""
    starts = plain_generators(sets)
    whole = {c for c, _ in starts.values()}
    return {k: v for k, v in plain_rules(sets, n, confidence).items() if k[0] in starts and tuple(sorted(k[0] + k[1])) in whole}


def implied(rule, value, found):
    a, c = map(set, rule)
    return any(set(x) <= a and c <= set(y) and abs(v[0] - value[0]) < 1e-9 and abs(v[1] - value[1]) < 1e-9 and v[2] >= value[2] - 1e-9
               for (x, y), v in found.items())


@pytest.mark.parametrize("seed,support,count", [(1, 0.02, 1), (2, 0.1, 3), (3, 0.0, 2)])
def test_against_plain_counting(spark, seed, support, count):
    rnd = random.Random(seed)
    make = lambda n, p: ["".join(x for x in "abcdefg" if rnd.random() < p) or "a" for _ in range(n)]
    baskets = {"big": make(120, 0.35), "small": make(12, 0.6), "all": ["abc"] * 5, "one": ["ab"], "hub": ["a" + x for x in make(40, 0.2)]}
    found = closed.generators(frame(spark, baskets), support, count)
    got = {(r["user_id"], tuple(r["items"])): (tuple(r["closed"]), r["item_count"]) for r in found.collect()}
    rules = {}
    for r in closed.rules(found, 0.3).collect():
        key = r["user_id"], tuple(r["antecedent"]), tuple(r["consequent"])
        assert key not in rules
        rules[key] = (r["support"], r["confidence"], r["lift"])
    want, want_rules = {}, {}
    for u, bs in baskets.items():
        sets = plain_sets(bs, max(support, count / len(bs)))
        want |= {(u, k): v for k, v in plain_generators(sets).items()}
        own = basis(sets, len(bs), 0.3)
        want_rules |= {(u, *k): v for k, v in own.items()}
        assert all(implied(k, v, own) for k, v in plain_rules(sets, len(bs), 0.3).items())
    assert got == want and set(rules) == set(want_rules)
    assert all(abs(x - y) <= 5.1e-5 for k, v in want_rules.items() for x, y in zip(rules[k], v))


def test_equal_orders_of_many_products(spark):
    """Two equal orders of 40 products, two of 70 that share 10 of them: more sets than could be listed."""
    forty, seventy = [f"p{i:03}" for i in range(40)], [f"p{i:03}" for i in range(30, 100)]
    baskets = {"u": [forty, forty, seventy, seventy, ["p000", "q"], ["q", "r"]]}
    found = closed.generators(frame(spark, baskets), 0.0, 2)
    got = {tuple(r["items"]): (len(r["closed"]), r["item_count"]) for r in found.collect()}
    want = {(x,): (40, 2) for x in forty[1:30]} | {(x,): (70, 2) for x in seventy[10:]} | {("p000",): (1, 3), ("q",): (1, 2)}
    want |= {(x,): (10, 4) for x in forty[30:]}
    # In the orders of one kind alone: a shared product beside p000 (others of that kind are in no other orders).
    want |= {("p000", x): (40, 2) for x in forty[30:]}
    assert got == want
    rules = [(tuple(r["antecedent"]), len(r["consequent"]), r["confidence"]) for r in closed.rules(found, 0.3).collect()]
    want_rules = [((x,), 39, 1.0) for x in forty[1:30]] + [((x,), 69, 1.0) for x in seventy[10:]] + [(("p000",), 39, 0.6667)]
    want_rules += [((x,), 9, 1.0) for x in forty[30:]] + [((x,), 39, 0.5) for x in forty[30:]] + [((x,), 69, 0.5) for x in forty[30:]]
    want_rules += [(("p000", x), 38, 1.0) for x in forty[30:]]
    assert sorted(rules) == sorted(want_rules)


def test_nothing_to_mine(spark):
    empty = closed.generators(frame(spark, {}), 0.01)
    assert empty.count() == 0 and closed.rules(empty).count() == 0
    assert closed.rules(closed.generators(frame(spark, {"u": ["ab", "cd"]}), 0.9)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_holders(spark, seed):
    rnd = random.Random(seed)
    items = "abcdefghij"
    owners = {(u, o): {x for i, x in enumerate(items) if rnd.random() < 0.7 / (1 + i / 4)} for u in "uv" for o in range(40)}
    sets = {(u, s): set(rnd.sample(items + "z", rnd.randint(1, 4))) for u in "uvw" for s in range(25)}
    rows = spark.createDataFrame([(u, o, x) for (u, o), xs in owners.items() for x in xs], "user_id string, o int, item string")
    made = spark.createDataFrame([(u, s, sorted(xs)) for (u, s), xs in sets.items()], "user_id string, set_id int, items array<string>")
    got = sorted(map(tuple, holders(made, rows, ["o"]).collect()))
    assert got == sorted((u, o, s) for (u, o), xs in owners.items() for (v, s), ys in sets.items() if u == v and ys <= xs)


def test_rule_scores_are_those_of_all_rules(spark):
    """The best score of a product under all rules is reached by one of these."""
    rnd = random.Random(9)
    bs = ["".join(x for x in "abcdef" if rnd.random() < 0.45) or "f" for _ in range(50)]
    sets = plain_sets(bs, 0.04)
    score = lambda v: 0.7 * v[1] + 0.3 * v[2] / (1 + v[2])
    every, few = plain_rules(sets, 50, basket.MIN_CONFIDENCE), basis(sets, 50, basket.MIN_CONFIDENCE)
    for k in range(1, 5):
        for held in itertools.combinations("abcdef", k):
            for p in set("abcdef") - set(held):
                best = [max((score(v) for (a, c), v in r.items() if set(a) <= set(held) and p in c), default=0) for r in (every, few)]
                assert abs(best[0] - best[1]) < 1e-9

"""Forecast pipeline against a plain-Python model on random and edge series."""

import datetime as dt
import random

import pytest

import sales_model as plain
from tillwater.operators.forecast import evaluate, model, older, series

START = dt.date(2026, 1, 1)


def random_series(seed, days=90):
    rnd = random.Random(seed)
    base = rnd.uniform(18000, 42000)
    active = rnd.choice([0.35, 0.67, 1.0])
    rows = []
    for i in range(days):
        d = START + dt.timedelta(days=i)
        if rnd.random() > active:
            rows.append((d, 0.0, 0.0, False))
            continue
        spike = rnd.uniform(1.45, 3.5) if rnd.random() < 0.12 else 1.0
        orders = rnd.randint(1, 9)
        rows.append((d, round(base * (0.82 + 0.28 * i / days) * spike * rnd.uniform(0.6, 1.4), 2), float(orders), True))
    if not any(r[3] for r in rows):
        rows[0] = (START, 100.0, 1.0, True)
    return rows


CASES = {f"s{n}": random_series(n, days) for n, days in enumerate([90, 90, 90, 40, 20, 12, 7, 6, 5, 150, 90, 33])}
CASES["flat"] = [(START + dt.timedelta(days=i), 100.0, 2.0, True) for i in range(60)]
CASES["one_day"] = [(START + dt.timedelta(days=i), 50.0 * (i == 3), float(i == 3), i == 3) for i in range(10)]
CASES["no_orders"] = [(START + dt.timedelta(days=i), 10.0 + i, 0.0, True) for i in range(20)]


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [(k, *r) for k, v in CASES.items() for r in v]
    daily = spark.createDataFrame(rows, "user_id string, date date, revenue double, orders double, observed boolean")
    return series.as_arrays(daily)


def test_forecast_points(predicted):
    points = model.forecast_points(model.run(predicted, 10)).collect()
    got = {(r["user_id"], r["forecast_date"]): r for r in points}
    for name, rows in CASES.items():
        for d, revenue, n, x, p, low, high in plain.forecast(rows, 10):
            r = got.pop((name, d))
            assert r["predicted_orders"] == n, (name, d)
            for c, v, tol in [("predicted_revenue", revenue, 0.006), ("expected_orders", x, 6e-5),
                              ("predicted_aov", p, 0.006), ("lower_bound", low, 0.006), ("upper_bound", high, 0.006)]:
                assert abs(r[c] - v) <= tol, (name, d, c, r[c], v)
    assert not got


def test_backtest_and_metrics(predicted):
    bt = evaluate.backtest(model.run(predicted, 1)).collect()
    got = {(r["user_id"], r["date"]): r for r in bt}
    for name, rows in CASES.items():
        for d, actual, v4, v41, base in plain.backtest(rows):
            r = got.pop((name, d))
            for c, v in [("actual", actual), ("v4", v4), ("v4_1", v41), ("baseline", base)]:
                assert abs(r[c] - v) <= 1e-6 * max(1, abs(v)), (name, d, c, r[c], v)
    assert not got


def test_older_model(predicted):
    bt = {(r["user_id"], r["date"]): r["predicted"] for r in older.backtest(predicted).collect()}
    for name, rows in CASES.items():
        for i in range(max(3, len(rows) - 14), len(rows)):
            e = plain.fit(rows[:i])
            if rows[i][3] and e["rev"]:
                v = plain.older_day(e, rows[i][0].weekday())
                assert abs(bt.pop((name, rows[i][0])) - v) <= 1e-6 * max(1, v)
    assert not bt
    points = older.forecast(predicted, 10).collect()
    assert len(points) == 10 * len(CASES)
    for name, rows in CASES.items():
        mine = sorted([p for p in points if p["user_id"] == name], key=lambda p: p["forecast_date"])
        counts = [int(r[2]) for r in rows]
        if not sum(counts):
            assert all(p["predicted_orders"] is None for p in mine)
            continue
        base, left = plain.wmean(counts[-14:]), 0.0
        for p in mine:
            left += base
            assert p["predicted_orders"] == int(left)
            left -= int(left)


def test_invariants(predicted):
    for p in model.forecast_points(model.run(predicted, 30)).collect():
        assert abs(p["predicted_orders"] * p["predicted_aov"] - p["predicted_revenue"]) <= 1.0
        assert 0 <= p["lower_bound"] <= p["upper_bound"]


def test_normalise(spark):
    points = spark.createDataFrame(
        [("a", "2026-01-01", "10", "1"), ("a", "2026-01-01", "5", "2"), ("a", "2026-01-04", "-3", "1"),
         ("a", "nope", "9", "9"), ("a", "2026-01-03", "x", None)],
        "user_id string, date string, revenue string, orders string",
    )
    rows = [tuple(r)[1:] for r in series.normalise(points).orderBy("date").collect()]
    d = dt.date
    assert rows == [
        (d(2026, 1, 1), 15.0, 3.0, True), (d(2026, 1, 2), 0.0, 0.0, False),
        (d(2026, 1, 3), 0.0, 0.0, False), (d(2026, 1, 4), 0.0, 1.0, False),
    ]

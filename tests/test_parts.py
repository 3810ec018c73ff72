"""Helpers, features, checks, segments, insights, explanations, notifications."""

import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tillwater.functions import scalars as S
from tillwater.functions.quantiles import exact_median
from tillwater.functions.ranking import full_rank, latest_per_key
from tillwater.operators import analyst, checks, churn, clv, dashboard, explain, features, insights, notify, segments


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0]["x"]


def test_number_prefixes(spark):
    ints = {"3abc": 3, "2.5": 2, " -7": -7, "x": None, "": None, None: None, "99999999999": None}
    floats = {"3.5kg": 3.5, ".5": 0.5, "-2": -2.0, "1e3x": 1000.0, "abc": None, "5.": 5.0}
    for text, want in ints.items():
        assert one(spark, S.int_prefix(F.lit(text).cast("string"))) == want
    for text, want in floats.items():
        assert one(spark, S.float_prefix(F.lit(text))) == want


def test_formats(spark):
    for value, text in {0: "0", 999.5: "1,000", 1234567.4: "12,34,567", 100000: "1,00,000", -45678: "-45,678", 12: "12"}.items():
        assert one(spark, S.grouped_in(F.lit(float(value)))) == text
    assert one(spark, S.money(F.lit(float("nan")))) == 0.0 and one(spark, S.money(F.lit(float("inf")))) == 0.0
    assert one(spark, S.money(F.lit(2.675))) == 2.68
    assert one(spark, analyst.as_percentage(F.lit(0.4))) == 40.0 and one(spark, analyst.as_percentage(F.lit(140.0))) == 100.0
    assert one(spark, analyst.risk_label(F.lit(" "), F.lit(0.7))) == "HIGH"


def test_exact_median_and_rank(spark):
    rnd = random.Random(5)
    groups = {"a": [round(rnd.uniform(-5, 1e6), 2) for _ in range(501)], "b": [round(rnd.expovariate(1e-4), 2) for _ in range(500)],
              "c": [7.25], "d": [1.0, 99999.99], "e": [5.0] * 40}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(7)
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m").collect()}
    for k, vs in groups.items():
        assert abs(got[k] - median(vs)) < 1e-6
    ranked = full_rank(df.withColumn("id", F.monotonically_increasing_id()), ["k"], [F.desc("v"), F.asc("id")])
    for k, vs in groups.items():
        rows = sorted((r["rank"], r["v"]) for r in ranked.filter(F.col("k") == k).collect())
        assert [r for r, _ in rows] == list(range(1, len(vs) + 1))
        assert [v for _, v in rows] == sorted(vs, reverse=True)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, ts int, v string")
    assert sorted(tuple(r) for r in latest_per_key(df, ["k"], "ts").collect()) == [("a", 2, "z"), ("b", 1, None)]


def orders(spark, rows):
    return spark.createDataFrame(
        [("u", c, f"o{i}", dt.datetime.fromisoformat(d), s, float(t)) for i, (c, d, s, t) in enumerate(rows)],
        "user_id string, customer_id string, order_id string, order_date timestamp, status string, total_amount double",
    )


def test_features_and_scores(spark):
    o = orders(spark, [("a", "2026-01-01", "completed", 10), ("a", "2026-01-11T12:00:00", "completed", 30), ("b", "2026-02-01", "shipped", 9),
                       ("c", "2026-03-01", "completed", 50)])
    f = features.customer_features(o, "2026-02-10")
    rows = {r["customer_id"]: tuple(r)[2:] for r in f.collect()}
    # The newest completed order is later than the run date and becomes the reference.
    assert rows == {"a": (48.5, 2.0, 40.0, 20.0, 10.5, 59.0), "c": (0.0, 1.0, 50.0, 50.0, 0.0, 0.0)}
    p = {r["customer_id"]: r for r in churn.predict_churn(f, "2026-02-10").collect()}
    # a: recency 1, frequency 1, monetary 0, gap 1, aov 0, tenure 1
    assert p["a"]["churn_probability"] == round(0.35 + 0 + 0.15 + 0.15 + 0.05 + 0, 4) and p["a"]["risk_level"] == "HIGH"
    assert p["c"]["churn_probability"] == round(0 + 0.25 + 0 + 0 + 0 + 0.05, 4) and not p["c"]["predicted_churn"]
    v = {r["customer_id"]: r for r in clv.predict_clv(f, "2026-02-10").collect()}
    # c: one order of 50, no tenure: 12 orders a year at full retention, default consistency
    assert v["c"]["predicted_value"] == round(12.5 + 12 * 50 * 0.95 * 0.60, 2) and v["c"]["confidence_score"] == 0.575
    single = churn.predict_churn(f.filter("customer_id = 'a'"), "2026-02-10").collect()[0]
    assert single["churn_probability"] == 0.5 and single["predicted_churn"]  # no range: all normalised values are 0
    ok = checks.churn_checks(churn.predict_churn(f, "2026-02-10"), f, f)
    checks.require(ok)
    bad = churn.predict_churn(f, "2026-02-10").withColumn("churn_probability", F.lit(1.5))
    with pytest.raises(checks.FailedChecks, match="probability_range: 2"):
        checks.require(checks.churn_checks(bad, f, f))


def test_quality_scales(spark):
    o = orders(spark, [("a", f"2026-01-{d:02d}", "completed", 1) for d in (1, 1, 2, 4, 5)])
    r = dashboard.history_quality(o).collect()[0]
    assert (r["observed_days"], r["calendar_days"], r["missing_days"], r["coverage"], r["quality"]) == (4, 5, 1, 0.8, "medium")
    r = dashboard.history_quality(o.filter("order_date < '2026-01-02'")).collect()[0]
    assert (r["quality"], r["coverage"]) == ("insufficient", 1.0)


def test_segments(spark):
    rnd = random.Random(1)
    rows = [("u", f"{g}{i}", r + rnd.random(), f + rnd.random(), m + rnd.random(), m / f)
            for g, (r, f, m) in {"h": (2, 20, 9000), "m": (40, 8, 3000), "l": (300, 1, 50)}.items() for i in range(15)]
    feats = spark.createDataFrame(rows, "user_id string, customer_id string, recency double, frequency double, monetary double, average_order_value double")
    got = {r["customer_id"]: r["segment_name"] for r in segments.segment(feats, "2026-01-01", restarts=3).collect()}
    assert len(got) == 45
    for c, name in got.items():
        assert name == {"h": "High Value", "m": "Regular", "l": "At Risk"}[c[0]]
    two = {r["segment_name"] for r in segments.segment(feats.filter("customer_id in ('h1', 'l1')"), "2026-01-01", restarts=1).collect()}
    assert two == {"High Value", "Regular"}
    with pytest.raises(segments.BadFeatures):
        segments.cluster(feats.filter("customer_id = 'h1'"))
    with pytest.raises(segments.BadFeatures):
        segments.cluster(feats.withColumn("recency", F.lit(float("nan"))))


DAY = dt.date(2026, 8, 10)  # a Monday


def forecast(spark, revenues, user="u", orders_=4.0):
    rows = [(user, DAY + dt.timedelta(days=i), float(r), 4, orders_, float(r) / 4) for i, r in enumerate(revenues)]
    return spark.createDataFrame(rows, "user_id string, forecast_date date, predicted_revenue double, predicted_orders bigint,"
                                 " expected_orders double, predicted_aov double")


def history(spark, revenue, orders_, days=9):
    rows = [("u", DAY - dt.timedelta(days=k), revenue if k % 2 else 0.0, orders_ if k % 2 else 0, bool(k % 2)) for k in range(1, 2 * days)]
    return spark.createDataFrame(rows, "user_id string, date date, revenue double, orders bigint, observed boolean")


def test_insights(spark):
    pts = forecast(spark, [100, 100, 100, 400, 50, 60, 100])
    past = history(spark, 200.0, 4)
    tr = insights.trends(pts, past).collect()[0]
    assert (tr["revenue_direction"], tr["revenue_change"]) == ("decreasing", -35.0)
    assert (tr["demand_direction"], tr["demand_change"]) == ("stable", 0.0)
    assert (tr["aov_direction"], tr["recent_aov"], tr["projected_aov"]) == ("decreasing", 50.0, 32.5)
    out = insights.revenue_outlook(pts).collect()[0]
    assert (out["next_7_days"], str(out["peak_date"]), str(out["lowest_date"])) == (910.0, "2026-08-13", "2026-08-14")
    cov = spark.createDataFrame([("u", 0.5), ("w", 0.9)], "user_id string, coverage double")
    spikes = spark.createDataFrame([("u", 2)], "user_id string, spike_days bigint")
    daily = past.unionByName(past.limit(1).withColumn("user_id", F.lit("w")))
    s = insights.insights(pts, daily, cov, spikes)
    risks = [(r["user_id"], r["type"]) for r in s["risks"].orderBy("user_id", "alert_no").collect()]
    assert risks == [("u", "revenue-volatility"), ("u", "data-coverage"), ("u", "historical-spikes"), ("w", "insufficient-forecast")]
    recs = s["recommendations"].orderBy("user_id", "place").collect()
    assert [(r["user_id"], r["category"], r["priority"]) for r in recs] == [
        ("u", "revenue-risk", "high"), ("u", "aov-risk", "high"), ("u", "peak-demand", "high"), ("u", "planning", "low"),
        ("w", "forecast-risk", "high"),
    ]
    assert recs[0]["recommendation"].endswith(
        "35.00% below recent observed revenue. Review demand-generation and conversion strategies before the forecast period."
        " Prioritize attention around 2026-08-14 (₹50) and 2026-08-15 (₹60).")
    assert recs[2]["supporting_dates"] == ["2026-08-13"] and "approximately 207.69% above" in recs[2]["recommendation"]


def test_explanations(spark):
    got = explain.explain_days(forecast(spark, [100, 100, 100, 200, 20])).orderBy("date").collect()
    assert [r["revenue_position"] for r in got] == ["normal", "normal", "normal", "high", "low"]
    assert got[0]["weekday"] == "Monday" and got[3]["deviation_percent"] == 92.31
    assert [x["message"] for x in got[3]["reasons"]] == [
        "Predicted revenue is +92.31% above the forecast-period average.", "Predicted AOV is +92.31% above the forecast-period average."]
    assert got[3]["business_implication"] == "Consider maintaining premium-product availability and upselling capacity."
    assert got[4]["business_implication"] == "Consider bundles, upselling, and cross-selling to improve transaction value."
    assert explain.explain_days(forecast(spark, [0, 0])).collect()[0]["revenue_position"] == "unknown"


def test_notifications(spark):
    pts = forecast(spark, [100, 100, 100, 123456, 20])
    cov = spark.createDataFrame([("u", 0.5)], "user_id string, coverage double")
    spikes = spark.createDataFrame([("u", 0)], "user_id string, spike_days bigint")
    s = insights.insights(pts, history(spark, 200.0, 4), cov, spikes)
    batch = notify.candidates(s["risks"], s["recommendations"], explain.explain_days(pts)).cache()
    checks.require(checks.notification_checks(batch))
    assert not batch.filter("title = 'Forecast-Based Planning'").count()
    assert batch.filter("title = 'Strong Forecast Day'").collect()[0]["message"] == (
        "2026-08-13 is forecast at ?1,23,456 revenue. Expected orders: 4.00 and predicted AOV: ?30,864.")
    # The same risk (without a date) twice in one batch: one is created, one skipped.
    risk = batch.filter("title = 'Limited Data Coverage'")
    created, skipped = notify.split_new(risk.unionByName(risk), batch.filter("false"), "2026-08-10")
    assert created.count() == 1 and skipped.collect()[0]["times"] == 1
    first, none = notify.split_new(batch, batch.filter("false"), "2026-08-10")
    assert first.count() == batch.count() and none.count() == 0
    second, skipped = notify.split_new(batch, first, "2026-08-11")
    assert second.count() == 0 and skipped.count() == batch.count()
    assert [r["rank"] for r in notify.listing(first, 3).collect()] == [1, 2, 3]
    counts = notify.unread_counts(first).collect()[0]
    assert counts["notifications"] == counts["unread"] == first.count()

"""Orders x order value forecast with trend, weekday and recency effects.

Production forecast and rolling backtest are one computation: a *cutoff* is a
day up to which (exclusive) the history is known. Every scored day of the
backtest is a cutoff, and so is the day after the last one. The history array
of a series is sliced per cutoff and all estimates are expressions on the
slice, so the whole pipeline needs the single shuffle that built the arrays.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions import arrays as A
from tillwater.functions.scalars import clamp, rounded

MODEL_VERSION = "sales-forecast-v4.1"
# Names of the three compared models.
ALGORITHM_BASELINE = "robust-weighted-moving-average"
ALGORITHM_V4 = "orders-times-dynamic-aov-robust-seasonal"
ALGORITHM = "orders-times-dynamic-aov-robust-seasonal-trend-adjusted"
# Model constants.
MIN_HISTORY, EVALUATION_DAYS = 5, 28
BASELINE_WINDOW, AOV_WINDOW, SPIKE_WINDOW, TREND_DAYS = 14, 30, 10, 14
MAX_ORDER_GROWTH, MIN_AOV, MAX_AOV_MULTIPLE = 0.25, 1.0, 2.5
ORDER_FACTOR_LOW, ORDER_FACTOR_HIGH, ORDER_FACTOR_PRIOR = 0.85, 1.15, 6.0
AOV_FACTOR_LOW, AOV_FACTOR_HIGH, AOV_FACTOR_SHRINK = 0.90, 1.10, 0.35
TREND_LOW, TREND_HIGH, AOV_TREND_LOW, AOV_TREND_HIGH = 0.60, 1.60, 0.85, 1.20
DAMP_NONE, DAMP_SINGLE, DAMP_REPEATED, DAMP_SPARSE = 1.00, 0.35, 0.75, 0.30
AOV_BLEND = (0.50, 0.30, 0.20)
NUDGE_ORDERS, NUDGE_AOV = (0.15, 0.95, 1.05), (0.10, 0.97, 1.03)
REVENUE_CALIBRATION = (0.12, 0.92, 1.08)
NORMAL_DAY_DAMPING = 0.85
REGIME_AOV_RATIO, REGIME_TREND, REGIME_ORDER_GROWTH = 1.15, 1.10, 1.05
CONFIDENCE_Z, INTERVAL_GROWTH = 1.96, 0.05


def with_cutoffs(
    arrays: DataFrame, evaluation_days: int = EVALUATION_DAYS, first_scored: int = MIN_HISTORY
) -> DataFrame:
    """One row per (series, cutoff): the training slice and, for scored days, the actual row."""
    long_enough = arrays.filter((F.size("hist") >= MIN_HISTORY) & F.exists("hist", lambda d: d["observed"]))
    n = F.size("hist")
    first = F.greatest(F.lit(first_scored), n - evaluation_days)
    indexed = F.transform("hist", lambda d, i: F.struct(i.alias("known"), d.alias("actual")))
    scored = F.filter(indexed, lambda c: (c["known"] >= first) & c["actual"]["observed"])
    no_actual = F.when(F.lit(False), F.get("hist", F.lit(0)))
    future = F.struct(n.alias("known"), no_actual.alias("actual"))
    return (
        long_enough.withColumn("_c", F.explode(F.concat(scored, F.array(future))))
        .withColumn("train", F.slice("hist", F.lit(1), F.col("_c.known")))
        .withColumn("actual", F.col("_c.actual"))
        .withColumn("last_date", F.element_at("hist", -1)["date"])
        .drop("_c", "hist")
    )


# Columns below name their inputs and belong to no frame, so they are built once per process:
# composing the nested array expressions costs more than analysing them.
@cache
def _slice_columns() -> dict[str, Column]:
    return {
        "rev": F.transform("obs", lambda d: d["revenue"]),
        "ord": F.transform("obs", lambda d: d["orders"]),
        "sold": F.filter("obs", lambda d: (d["revenue"] > 0) & (d["orders"] > 0)),
        "aovs": F.transform(F.filter("obs", lambda d: d["orders"] > 0), lambda d: d["revenue"] / d["orders"]),
        "n_days": F.size("train"),
    }


@cache
def _estimate_columns() -> dict[str, Column]:
    rev, last_orders = F.col("rev"), A.last(F.col("ord"), BASELINE_WINDOW)
    recent_spikes = A.let(A.last(rev, SPIKE_WINDOW), lambda r: A.let(
        A.spike_limit(r), lambda cap: F.size(F.filter(r, lambda x: A.is_spike(x, cap)))
    ))
    return {
        "n_obs": F.size("rev"),
        "est_aov": order_value(F.col("sold")),
        "order_base": F.greatest(F.lit(0.0), A.weighted_mean(A.winsorised(last_orders))),
        "order_factors": order_factors(F.col("obs"), rev),
        "aov_factors": aov_factors(F.col("sold")),
        "spike_cap": A.spike_limit(rev),
        "recent_spikes": F.when(F.size("rev") >= 5, recent_spikes),
    }


@cache
def _settled_columns() -> dict[str, Column]:
    fallback = F.coalesce(A.log_baseline(A.last(F.col("rev"), BASELINE_WINDOW)), F.lit(0.0))
    return {
        "aov": F.coalesce("est_aov", fallback),
        "order_base": F.coalesce("order_base", F.lit(0.0)),
        "spike_days": F.size(F.filter("rev", lambda x: A.is_spike(x, F.col("spike_cap")))),
    }


def estimates(cutoffs: DataFrame) -> DataFrame:
    """Baselines, weekday factors, lags and trends of each training slice."""
    df = cutoffs.withColumn("obs", F.filter("train", lambda d: d["observed"])).withColumns(_slice_columns())
    df = df.withColumns(_estimate_columns()).withColumns(lag_features())
    # Without a usable order value the backtest skips the day; production falls back.
    usable = F.col("actual").isNull() | (F.col("est_aov").isNotNull() & F.col("order_base").isNotNull())
    return df.filter(usable).withColumns(_settled_columns())


def order_value(sold: Column) -> Column:
    """Revenue / orders of the last sold days without spikes (with them if under five remain)."""
    def estimate(recent: Column) -> Column:
        cap = A.spike_limit(F.transform(recent, lambda d: d["revenue"]))
        return A.let(
            A.let(cap, lambda c: F.filter(recent, lambda d: ~A.is_spike(d["revenue"], c))),
            lambda normal: A.let(
                F.when(F.size(normal) < 5, recent).otherwise(normal),
                lambda days: F.greatest(
                    F.lit(MIN_AOV),
                    A.total(F.transform(days, lambda d: d["revenue"])) / A.total(F.transform(days, lambda d: d["orders"])),
                ),
            ),
        )

    return F.when(F.size(sold) > 0, A.let(A.last(sold, AOV_WINDOW), estimate))


def _weekday_factors(values: Column, usable: Column, factor) -> Column:
    """Seven factors (Monday first) from an array of (wd, v) without spikes; 1 where not usable."""
    ones = F.array_repeat(F.lit(1.0), 7)

    def from_normal(normal: Column) -> Column:
        base = A.log_baseline(F.transform(normal, lambda d: d["v"]))
        per_day = lambda b: F.transform(
            F.sequence(F.lit(0), F.lit(6)),
            lambda w: A.let(
                F.transform(F.filter(normal, lambda d: d["wd"] == w), lambda d: d["v"]),
                lambda vs: F.coalesce(factor(vs, b), F.lit(1.0)),
            ),
        )
        return F.when(
            F.size(normal) >= 7, A.let(base, lambda b: F.when(b > 0, per_day(b)).otherwise(ones))
        ).otherwise(ones)

    cap = A.spike_limit(F.transform(values, lambda d: d["v"]))
    normal = A.let(cap, lambda c: F.filter(values, lambda d: ~A.is_spike(d["v"], c)))
    return F.when(usable, A.let(normal, from_normal)).otherwise(ones)


def order_factors(obs: Column, rev: Column) -> Column:
    """Weekday factors of demand, estimated on revenue and shrunk by sample size."""
    values = F.transform(obs, lambda d: F.struct(d["wd"].alias("wd"), d["revenue"].alias("v")))

    def factor(vs: Column, base: Column) -> Column:
        n = F.size(vs).cast("double")
        raw = 1.0 + (A.log_baseline(vs) / base - 1.0) * (n / (n + ORDER_FACTOR_PRIOR))
        return F.when(F.size(vs) > 0, clamp(raw, ORDER_FACTOR_LOW, ORDER_FACTOR_HIGH))

    return _weekday_factors(values, F.size(rev) >= 14, factor)


def aov_factors(sold: Column) -> Column:
    """Weekday factors of the order value, strongly shrunk; two samples needed."""
    values = F.transform(sold, lambda d: F.struct(d["wd"].alias("wd"), (d["revenue"] / d["orders"]).alias("v")))

    def factor(vs: Column, base: Column) -> Column:
        return F.when(
            F.size(vs) >= 2,
            A.let(
                A.log_baseline(vs),
                lambda b: F.when(
                    b > 0,
                    clamp(1.0 + AOV_FACTOR_SHRINK * (b / base - 1.0), AOV_FACTOR_LOW, AOV_FACTOR_HIGH),
                ),
            ),
        )

    return _weekday_factors(values, F.size(sold) >= 7, factor)


@cache
def lag_features() -> dict[str, Column]:
    rev, orders, aovs = F.col("rev"), F.col("ord"), F.col("aovs")
    enough = F.size(rev) >= TREND_DAYS

    def trend(values: Column) -> Column:
        now, earlier = A.total(A.last(values, 7)), A.total(A.before_last(values, 7, 7))
        return F.when(
            enough & (earlier > 0), clamp(F.try_divide(now, earlier), TREND_LOW, TREND_HIGH)
        ).otherwise(1.0)

    full = F.size(aovs) >= TREND_DAYS
    recent = F.when(F.size(aovs) >= 4, A.mean(A.last(aovs, 7)))
    previous = F.when(full, A.mean(A.before_last(aovs, 7, 7)))
    spikes = F.col("recent_spikes")
    return {
        "revenue_lag1": A.nth_last(rev, 1),
        "revenue_lag7": A.nth_last(rev, 7),
        "revenue_rolling7": A.mean(A.last(rev, 7)),
        "orders_lag1": A.nth_last(orders, 1),
        "orders_lag7": A.nth_last(orders, 7),
        "orders_rolling7": A.mean(A.last(orders, 7)),
        "aov_lag1": A.nth_last(aovs, 1),
        # One place further back than the other lags; kept so.
        "aov_lag7": A.nth_last(aovs, 8),
        "aov_rolling7": F.when(F.size(aovs) >= 2, A.mean(A.last(aovs, 7))),
        "revenue_trend": trend(rev),
        "order_trend": trend(orders),
        "recent_aov": recent,
        "previous_aov": previous,
        "aov_trend": F.when(
            full & (previous > 0), clamp(F.try_divide(recent, previous), AOV_TREND_LOW, AOV_TREND_HIGH)
        ).otherwise(1.0),
        "damping": F.when(spikes >= 2, DAMP_REPEATED).when(spikes == 1, DAMP_SINGLE)
        .when(spikes == 0, DAMP_NONE).otherwise(DAMP_SPARSE),
        "spike_count_recent": F.coalesce(spikes, F.lit(0)),
    }


def _nudge(lag1: str, lag7: str, rolling: str, weight: float, low: float, high: float) -> Column:
    points = F.filter(F.array(F.col(lag1), F.col(lag7)), lambda x: x.isNotNull())
    ratio = F.try_divide(A.mean(points), F.col(rolling))
    usable = (F.size(points) > 0) & (F.col(rolling) > 0) & (A.mean(points) > 0)
    return F.when(usable, clamp(1.0 + weight * (ratio - 1.0), low, high)).otherwise(1.0)


def whole_orders(c: Column) -> Column:
    """Half-even rounding to whole orders, never negative."""
    return F.greatest(F.lit(0.0), F.bround(c, 0))


def targets(est: DataFrame, horizon: int) -> DataFrame:
    """Days to predict: the cutoff day itself in the backtest, the horizon after the last day otherwise."""
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.struct(F.date_add(F.col("last_date"), k).alias("date"), k.alias("step")),
    )
    scored = F.array(F.struct(F.col("actual.date").alias("date"), F.lit(1).alias("step")))
    return (
        est.withColumn("_t", F.explode(F.when(F.col("actual").isNull(), ahead).otherwise(scored)))
        .withColumn("date", F.col("_t.date"))
        .withColumn("step", F.col("_t.step"))
        .withColumn("wd", F.weekday("date"))
        .withColumn("f_orders", F.get("order_factors", F.col("wd")))
        .withColumn("f_aov", F.get("aov_factors", F.col("wd")))
        .drop("_t")
    )


@cache
def _prediction_columns() -> list[dict[str, Column]]:
    base, aov, damp = F.col("order_base"), F.col("aov"), F.col("damping")
    v4_expected = F.least(F.greatest(F.lit(0.0), base * F.col("f_orders")), base * (1.0 + MAX_ORDER_GROWTH))
    trended = base * F.greatest(F.lit(0.0), 1.0 + damp * (F.col("order_trend") - 1.0))
    floor_aov = F.greatest(aov, F.lit(MIN_AOV))
    w0, w1, w2 = AOV_BLEND
    blended = (
        floor_aov * w0
        + F.coalesce(F.col("recent_aov"), floor_aov) * w1
        + F.coalesce(F.col("previous_aov"), floor_aov) * w2
    ) / (w0 + w1 + w2)
    trend_aov = F.greatest(F.lit(0.0), 1.0 + damp * (F.col("aov_trend") - 1.0))
    raw_aov = blended * trend_aov * F.col("f_aov") * _nudge("aov_lag1", "aov_lag7", "aov_rolling7", *NUDGE_AOV)
    first = {
        "v4_orders": whole_orders(v4_expected),
        "v4_aov": aov * F.col("f_aov"),
        "_trended": trended,
        "_nudge": _nudge("orders_lag1", "orders_lag7", "orders_rolling7", *NUDGE_ORDERS),
        "_aov0": F.least(F.greatest(F.lit(MIN_AOV), raw_aov), floor_aov * MAX_AOV_MULTIPLE),
    }
    expected = F.least(
        F.greatest(F.lit(0.0), F.col("_trended") * F.col("f_orders") * F.col("_nudge")),
        F.col("_trended") * (1.0 + MAX_ORDER_GROWTH),
    )
    orders = F.col("predicted_orders")
    # Calibration toward what the revenue lags suggest.
    positives = F.filter(
        F.array("revenue_lag1", "revenue_lag7", "revenue_rolling7"), lambda x: x.isNotNull() & (x > 0)
    )
    reference = F.try_divide(A.mean(positives) * F.col("revenue_trend"), orders)
    weight, low, high = REVENUE_CALIBRATION
    calibrated = F.greatest(
        F.lit(MIN_AOV),
        F.col("_aov0") * clamp(1.0 + weight * (reference / F.col("_aov0") - 1.0), low, high),
    )
    usable = (orders > 0) & (F.size(positives) > 0) & (reference > 0)
    # Damping of ordinary days; corroborated repeated spikes are left alone.
    dear = (F.col("recent_aov") >= aov * REGIME_AOV_RATIO) & (F.col("aov_trend") >= REGIME_TREND) & (aov > 0)
    growth = F.when(base > 0, F.try_divide(orders, base)).otherwise(1.0)
    busy = (F.col("order_trend") >= REGIME_TREND) | (growth >= REGIME_ORDER_GROWTH)
    regime = (damp == DAMP_REPEATED) & (F.coalesce(dear, F.lit(False)) | busy)
    damped = F.greatest(F.lit(MIN_AOV), F.col("_aov1") * F.when(regime, 1.0).otherwise(NORMAL_DAY_DAMPING))
    return [
        first,
        {"expected_orders": expected},
        {"predicted_orders": whole_orders(F.col("expected_orders"))},
        {"_aov1": F.when(usable, calibrated).otherwise(F.col("_aov0"))},
        {"predicted_aov": F.when(orders > 0, damped).otherwise(F.col("_aov1"))},
        {"predicted_revenue": orders * F.col("predicted_aov"), "v4_revenue": F.col("v4_orders") * F.col("v4_aov")},
    ]


def predictions(tgt: DataFrame) -> DataFrame:
    """Adds V4 and V4.1 orders, order value and revenue."""
    for stage in _prediction_columns():
        tgt = tgt.withColumns(stage)
    return tgt.drop("_trended", "_nudge", "_aov0", "_aov1")


@cache
def error_spread() -> Column:
    """Dispersion of the reconstructed history. Unobserved days enter as zero residuals, spikes do not."""
    kept = F.filter("train", lambda d: ~(d["observed"] & A.is_spike(d["revenue"], F.col("spike_cap"))))
    residuals = F.transform(
        kept, lambda d: d["revenue"] - d["orders"] * F.col("aov") * F.get(F.col("aov_factors"), d["wd"])
    )
    spread = F.coalesce(A.stddev(residuals), F.greatest(F.col("aov") * 0.25, F.lit(1.0)))
    return F.greatest(spread, F.col("aov") * 0.10, F.lit(1.0))


@cache
def legacy_prediction() -> Column:
    """One-step prediction of the older moving-average model for weekday ``wd``."""
    def parts(recent: Column) -> Column:
        return F.struct(recent.alias("recent"), A.robust_clipped(recent).alias("clipped"))

    rate = F.col("n_obs") / F.col("n_days").cast("double")

    def predict(p: Column) -> Column:
        selling = F.greatest(F.lit(0.0), A.weighted_mean(p["clipped"]))
        base = selling * rate
        cap = F.greatest(base * 0.03, F.lit(1.0))
        step = legacy_slope(p["recent"], p["clipped"], cap, F.col("n_obs"), rate)
        seasonal = base * F.col("legacy_factor")
        minimum_error = F.greatest(base * 0.10, selling * F.greatest(F.lit(0.10), 1.0 - rate), F.lit(1.0))
        high = F.greatest(seasonal * 1.5, seasonal + minimum_error)
        value = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), base + step) * F.col("legacy_factor"))
        return F.least(F.greatest(value, F.greatest(F.lit(0.0), seasonal * 0.5)), high)

    return F.when(F.col("n_obs") > 0, A.let(parts(A.last(F.col("rev"), BASELINE_WINDOW)), predict)).otherwise(0.0)


@cache
def legacy_day_factor() -> Column:
    """Older weekday factor of weekday ``wd``."""
    return F.get(legacy_factors(F.col("obs"), F.col("rev")), F.col("wd"))


def legacy_slope(recent: Column, clipped: Column, cap: Column, n_obs: Column, rate: Column) -> Column:
    """Bounded slope, reduced for noisy windows and for short or sparse histories."""
    mean = A.mean(recent)
    cv = F.when((F.size(recent) >= 5) & (mean > 0), A.stddev(recent) / mean)
    noisy = F.when(cv > 1.0, 0.25).when(cv > 0.75, 0.5).otherwise(1.0)
    thin = F.when(n_obs < 7, 0.0).when((n_obs < 14) | (rate < 0.5), 0.2).when(n_obs < 30, 0.5).otherwise(1.0)
    return F.least(F.greatest(A.slope(clipped), -cap), cap) * noisy * thin


def legacy_factors(obs: Column, rev: Column) -> Column:
    """Weekday factors of the older model: ratio of robust means, full weight from six samples on."""
    ones = F.array_repeat(F.lit(1.0), 7)

    def factor(vs: Column, overall: Column) -> Column:
        return F.when(
            F.size(vs) >= 2,
            A.let(
                A.mean(A.robust_clipped(vs)),
                lambda m: F.when(
                    m > 0,
                    clamp(
                        1.0 + (m / overall - 1.0) * F.least(F.lit(1.0), F.size(vs).cast("double") / 6.0), 0.75, 1.25
                    ),
                ),
            ),
        )

    per_day = lambda overall: F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda w: A.let(
            F.transform(F.filter(obs, lambda d: d["wd"] == w), lambda d: d["revenue"]),
            lambda vs: F.coalesce(factor(vs, overall), F.lit(1.0)),
        ),
    )
    return F.when(
        F.size(rev) >= 14,
        A.let(A.mean(A.robust_clipped(rev)), lambda g: F.when(g > 0, per_day(g)).otherwise(ones)),
    ).otherwise(ones)


def run(arrays: DataFrame, horizon: int) -> DataFrame:
    """Predictions for every backtest day and every future day of every series."""
    return predictions(targets(estimates(with_cutoffs(arrays)), horizon))


def forecast_points(predicted: DataFrame, series: str = "user_id") -> DataFrame:
    """Future days with rounded values and the widening prediction interval."""
    future = predicted.filter(F.col("actual").isNull()).withColumn("_sd", error_spread())
    reach = CONFIDENCE_Z * F.col("_sd") * (1.0 + INTERVAL_GROWTH * (F.col("step") - 1))
    return future.select(
        series,
        F.col("date").alias("forecast_date"),
        rounded(F.col("predicted_revenue"), 2).alias("predicted_revenue"),
        F.col("predicted_orders").cast("long").alias("predicted_orders"),
        rounded(F.col("expected_orders"), 4).alias("expected_orders"),
        rounded(F.col("predicted_aov"), 2).alias("predicted_aov"),
        rounded(F.greatest(F.lit(0.0), F.col("predicted_revenue") - reach), 2).alias("lower_bound"),
        rounded(F.col("predicted_revenue") + reach, 2).alias("upper_bound"),
        rounded(F.col("v4_revenue"), 2).alias("v4_revenue"),
        F.col("v4_orders").cast("long").alias("v4_orders"),
        rounded(F.col("v4_aov"), 2).alias("v4_aov"),
    )


def diagnostics(predicted: DataFrame, series: str = "user_id") -> DataFrame:
    """Estimates behind the production forecast, one row per series."""
    row = predicted.filter(F.col("actual").isNull() & (F.col("step") == 1))
    two = ["aov", "revenue_lag1", "revenue_lag7", "orders_lag1", "orders_lag7", "aov_lag1", "aov_lag7",
           "revenue_rolling7", "aov_rolling7"]
    four = ["revenue_trend", "order_trend", "aov_trend"]
    return row.select(
        series,
        rounded(F.col("order_base"), 3).alias("order_baseline"),
        F.transform("order_factors", lambda x: F.round(x, 4)).alias("weekday_factors"),
        F.transform("aov_factors", lambda x: F.round(x, 4)).alias("aov_weekday_factors"),
        F.col("spike_days").cast("long").alias("spike_days"),
        F.col("spike_count_recent").cast("long").alias("spike_count_recent"),
        rounded(F.col("orders_rolling7"), 3).alias("orders_rolling7"),
        F.col("damping").alias("damping"),
        *[rounded(F.col(c), 2).alias(c) for c in two],
        *[rounded(F.col(c), 4).alias(c) for c in four],
    )

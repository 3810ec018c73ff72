"""Robust statistics over short arrays (one array = the days of one series).

A series is at most a few hundred calendar days long, so its history travels
as one array column and every statistic is an expression: no shuffle, no
Python. Functions take and return columns; an empty array gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of the median absolute deviation to a standard deviation, and the width of the robust band.
MAD_SCALE, MAD_WIDTH = 1.4826, 3.0
SPIKE_MIN_MAD = 1e-9
WINSOR_LOW, WINSOR_HIGH, WINSOR_MIN = 0.05, 0.90, 5
ROBUST_MIN = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def last(a: Column, n: int) -> Column:
    """The last ``n`` elements, all of them if fewer."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def before_last(a: Column, skip: int, n: int) -> Column:
    """``n`` elements that end ``skip`` elements before the end; needs skip + n elements."""
    return F.slice(a, F.greatest(F.size(a) - skip - n + 1, F.lit(1)), F.lit(n))


def nth_last(a: Column, n: int) -> Column:
    """n-th element from the end, null if there are fewer."""
    return F.when(F.size(a) >= n, F.get(a, F.size(a) - n))


def _quantile_sorted(s: Column, q: float) -> Column:
    place = F.lit(q) * (F.size(s) - 1).cast("double")
    low = F.floor(place).cast("int")
    lower, upper = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return lower + (upper - lower) * (place - low.cast("double"))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return let(F.array_sort(a), lambda s: _quantile_sorted(s, q))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def weighted_mean(a: Column) -> Column:
    """Weights 1..n in order, normalised before use."""
    n = F.size(a).cast("double")
    weights = n * (n + 1) / 2
    weighted = F.transform(a, lambda x, i: x * ((i + 1).cast("double") / weights))
    return F.when(F.size(a) > 0, total(weighted))


def stddev(a: Column) -> Column:
    """Sample standard deviation; null below two elements."""
    return F.when(
        F.size(a) >= 2,
        let(
            mean(a),
            lambda m: F.sqrt(
                total(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - 1).cast("double")
            ),
        ),
    )


def clip(a: Column, low: Column, high: Column) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, low), high))


def winsorised(a: Column) -> Column:
    """Clip to the 5th and 90th percentile where these differ; short arrays stay."""
    return let(
        F.array_sort(a),
        lambda s: let(
            F.struct(_quantile_sorted(s, WINSOR_LOW).alias("lo"), _quantile_sorted(s, WINSOR_HIGH).alias("hi")),
            lambda q: F.when(
                (F.size(a) >= WINSOR_MIN) & (q["hi"] > q["lo"]), clip(a, q["lo"], q["hi"])
            ).otherwise(a),
        ),
    )


def log_baseline(a: Column) -> Column:
    """Recency-weighted mean of the winsorised values in log space."""
    logs = F.transform(winsorised(a), F.log1p)
    return F.greatest(F.lit(0.0), F.expm1(weighted_mean(logs)))


def spike_limit(a: Column) -> Column:
    """Upper limit of log1p(value); infinite if the deviations vanish or the array is empty."""
    logs = F.transform(a, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))

    def limit(ls: Column) -> Column:
        return let(
            median(ls),
            lambda m: let(
                median(F.transform(ls, lambda x: F.abs(x - m))),
                lambda mad: F.when(mad > SPIKE_MIN_MAD, m + MAD_WIDTH * (MAD_SCALE * mad)).otherwise(
                    F.lit(float("inf"))
                ),
            ),
        )

    return let(logs, limit)


def is_spike(value: Column, limit: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0))) > limit


def robust_clipped(a: Column) -> Column:
    """Clip to median +- 3 scaled deviations, from three values on."""
    def clipped(m: Column) -> Column:
        return let(
            median(F.transform(a, lambda x: F.abs(x - m))),
            lambda mad: F.when(
                mad > 0,
                clip(a, m - MAD_WIDTH * (MAD_SCALE * mad), m + MAD_WIDTH * (MAD_SCALE * mad)),
            ).otherwise(a),
        )

    return F.when(F.size(a) >= ROBUST_MIN, let(median(a), clipped)).otherwise(a)


def slope(a: Column) -> Column:
    """Least-squares slope over positions 0..n-1; 0 below three values."""
    n = F.size(a).cast("double")
    centre = (n - 1) / 2
    return F.when(
        F.size(a) >= ROBUST_MIN,
        let(
            mean(a),
            lambda m: total(F.transform(a, lambda x, i: (i.cast("double") - centre) * (x - m)))
            / (n * (n * n - 1) / 12),
        ),
    ).otherwise(0.0)

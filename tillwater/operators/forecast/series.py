"""Daily series: from orders or from given points to one history array per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import exact_sum, money
from tillwater.operators.dashboard import completed, filled_days

LOOKBACK_DAYS = 90
MAX_HORIZON, DEFAULT_HORIZON = 365, 30


def horizon(days: int | None) -> int:
    return DEFAULT_HORIZON if days is None else max(1, min(MAX_HORIZON, int(days)))


def order_history(orders: DataFrame, as_of: str, series: str = "user_id", lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Completed orders of the last ``lookback`` days as one row per day, zero-filled.

    The window is a literal range on the order date, so it reaches the scan.
    Orders after ``as_of`` pass the load filter but have no day in the calendar.
    """
    end = F.to_date(F.lit(as_of))
    start = F.date_sub(end, lookback - 1)
    by_day = (
        completed(orders)
        .filter(F.col("order_date") >= start.cast("timestamp"))
        .groupBy(series, F.to_date("order_date").alias("date"))
        .agg(exact_sum(F.col("total_amount")).cast("double").alias("_rev"), F.count(F.lit(1)).alias("_n"))
    )
    # Days outside the calendar are simply never looked up.
    return filled_days(by_day, series, "date", ["_rev", "_n"], start, end).select(
        series,
        "date",
        money(F.col("_rev")).alias("revenue"),
        F.coalesce("_n", F.lit(0)).alias("orders"),
        F.col("_n").isNotNull().alias("observed"),
    )


def normalise(points: DataFrame, series: str = "user_id") -> DataFrame:
    """Given points to a contiguous daily series.

    Unreadable dates are dropped, negative or missing numbers become 0, equal
    days are summed, gaps are filled as unobserved. Without an ``observed``
    column a day counts as observed when it has revenue.
    """
    number = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)))
    typed = points.withColumn("date", F.col("date").try_cast("date")).filter("date is not null")
    typed = typed.withColumn("revenue", number("revenue"))
    typed = typed.withColumn("orders", number("orders") if "orders" in points.columns else F.lit(0.0))
    observed = F.coalesce(F.col("observed"), F.lit(False)) if "observed" in points.columns else F.col("revenue") > 0
    by_day = (
        typed.withColumn("observed", observed)
        .groupBy(series, "date")
        .agg(
            F.sum(F.col("revenue").cast("decimal(28,6)")).cast("double").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.max("observed").alias("observed"),
        )
    )
    return filled_days(by_day, series, "date", ["revenue", "orders", "observed"]).select(
        series,
        "date",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("orders", F.lit(0.0)).alias("orders"),
        F.coalesce("observed", F.lit(False)).alias("observed"),
    )


def as_arrays(daily: DataFrame, series: str = "user_id") -> DataFrame:
    """One row per series with its days in order. The array holds days, not orders,
    so its length is the calendar span of the series.

    The rows are few and small but costly to evaluate later on, so the number of
    partitions is stated: adaptive execution would merge them by size.
    """
    day = F.struct(
        "date",
        F.weekday("date").alias("wd"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("orders").cast("double").alias("orders"),
        "observed",
    )
    partitions = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return daily.repartition(partitions, series).groupBy(series).agg(F.array_sort(F.collect_list(day)).alias("hist"))


def series_quality(daily: DataFrame, series: str = "user_id") -> DataFrame:
    """Observed and calendar days, coverage, quality, confidence and sparsity of each series."""
    n, days = F.col("observed_days"), F.col("calendar_days")
    coverage = F.try_divide(n.cast("double"), days.cast("double"))
    quality = F.when(n >= 30, "high").when(n >= 14, "medium").otherwise("low")
    return (
        daily.groupBy(series)
        .agg(F.count_if("observed").alias("observed_days"), F.count(F.lit(1)).alias("calendar_days"))
        .select(
            series,
            "observed_days",
            "calendar_days",
            (days - n).alias("missing_days"),
            F.round(coverage, 4).alias("coverage"),
            quality.alias("quality"),
            quality.alias("confidence"),
            ((n < 14) | (coverage < 0.5)).alias("is_sparse"),
        )
    )

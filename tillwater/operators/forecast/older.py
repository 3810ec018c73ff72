"""The older multi-day model: selling-day baseline x occurrence rate + bounded trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions import arrays as A
from tillwater.functions.scalars import rounded
from tillwater.operators.forecast import model

MODEL_VERSION = "sales-forecast-v2"
EVALUATION_DAYS, FIRST_SCORED = 14, 3


def _prepared(df: DataFrame) -> DataFrame:
    df = df.withColumn("obs", F.filter("train", lambda d: d["observed"]))
    df = df.withColumns({"rev": F.transform("obs", lambda d: d["revenue"]), "n_days": F.size("train")})
    df = df.withColumns({"n_obs": F.size("rev"), "recent": A.last(F.col("rev"), model.BASELINE_WINDOW)})
    return df.withColumns(
        {
            "clipped": A.robust_clipped(F.col("recent")),
            "factors": model.legacy_factors(F.col("obs"), F.col("rev")),
            "rate": F.col("n_obs") / F.col("n_days").cast("double"),
        }
    )


def order_counts(baseline: Column, horizon: int) -> Column:
    """Whole orders per day: the fraction left over is carried to the next day."""
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<bigint>").alias("counts"))

    def step(acc: Column, _: Column) -> Column:
        due = acc["left"] + baseline
        whole = F.floor(due)
        return F.struct(
            (due - whole.cast("double")).alias("left"), F.concat(acc["counts"], F.array(whole)).alias("counts")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["counts"])


def forecast(arrays: DataFrame, horizon: int, series: str = "user_id") -> DataFrame:
    usable = arrays.filter(
        (F.size("hist") >= model.MIN_HISTORY) & F.exists("hist", lambda d: d["observed"])
    ).withColumn("train", F.col("hist"))
    df = _prepared(usable).withColumn(
        "selling", F.greatest(F.lit(0.0), A.weighted_mean(F.col("clipped")))
    ).withColumn("base", F.col("selling") * F.col("rate"))
    daily_orders = F.transform("train", lambda d: F.floor(d["orders"]).cast("double"))
    df = df.withColumns(
        {
            "step_size": model.legacy_slope(
                F.col("recent"), F.col("clipped"), F.greatest(F.col("base") * 0.03, F.lit(1.0)), F.col("n_obs"), F.col("rate")
            ),
            # Here the order baseline runs over calendar days, without sales ones included.
            "order_base": F.when(
                A.total(daily_orders) > 0, A.weighted_mean(A.last(daily_orders, model.BASELINE_WINDOW))
            ),
            "last_date": F.element_at("train", -1)["date"],
        }
    )
    df = df.withColumn("counts", order_counts(F.col("order_base"), horizon))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "date", F.date_add(F.col("last_date"), F.col("k"))
    )
    seasonal = F.col("base") * F.get("factors", F.weekday("date"))
    minimum_error = F.greatest(
        F.col("base") * 0.10, F.col("selling") * F.greatest(F.lit(0.10), 1.0 - F.col("rate")), F.lit(1.0)
    )
    raw = F.greatest(F.lit(0.0), F.col("base") + F.col("step_size") * F.col("k")) * F.get("factors", F.weekday("date"))
    df = df.withColumns({"seasonal": seasonal, "raw": raw, "min_error": minimum_error}).withColumn(
        "predicted",
        F.least(
            F.greatest(F.col("raw"), F.col("seasonal") * 0.5),
            F.greatest(F.col("seasonal") * 1.5, F.col("seasonal") + F.col("min_error")),
        ),
    )
    widening = F.least(F.lit(0.25), 0.10 + F.col("k") / F.lit(float(horizon)) * 0.15)
    reach = F.greatest(F.col("seasonal") * 0.10, F.lit(1.0), F.col("predicted") * widening)
    return df.withColumn("reach", reach).select(
        series,
        F.col("date").alias("forecast_date"),
        rounded(F.col("predicted"), 2).alias("predicted_revenue"),
        F.get("counts", F.col("k") - 1).alias("predicted_orders"),
        rounded(F.greatest(F.lit(0.0), F.col("predicted") - F.col("reach")), 2).alias("lower_bound"),
        rounded(F.col("predicted") + F.col("reach"), 2).alias("upper_bound"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def backtest(arrays: DataFrame, series: str = "user_id") -> DataFrame:
    """One-step predictions of the last 14 calendar days that have sales."""
    df = _prepared(model.with_cutoffs(arrays, EVALUATION_DAYS, FIRST_SCORED).filter(F.col("actual").isNotNull()))
    df = df.withColumn("legacy_factor", F.get("factors", F.col("actual.wd")))
    return df.filter("n_obs > 0").select(
        series,
        F.col("actual.date").alias("date"),
        F.col("actual.revenue").alias("actual"),
        model.legacy_prediction().alias("predicted"),
    )

"""Rolling one-step evaluation: per-day rows, error metrics, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import rounded
from tillwater.operators.forecast import model

LIMITED_MESSAGE = "Forecast accuracy evaluation is based on a limited number of observed holdout days."


def backtest(predicted: DataFrame, series: str = "user_id") -> DataFrame:
    """Actual and the three predictions of every scored day (unrounded)."""
    scored = predicted.filter(F.col("actual").isNotNull())
    scored = scored.withColumn("legacy_factor", model.legacy_day_factor())
    return scored.select(
        series,
        "date",
        F.col("actual.revenue").alias("actual"),
        F.col("actual.orders").alias("orders"),
        F.col("v4_revenue").alias("v4"),
        F.col("predicted_revenue").alias("v4_1"),
        model.legacy_prediction().alias("baseline"),
    )


def evaluation_days(bt: DataFrame, series: str = "user_id") -> DataFrame:
    """Per-day rows with absolute and percentage errors."""
    columns = []
    for m in ("v4", "v4_1", "baseline"):
        error = F.abs(F.col("actual") - F.col(m))
        columns += [
            rounded(F.col(m), 2).alias(f"{m}_prediction"),
            rounded(error, 2).alias(f"{m}_absolute_error"),
            rounded(F.try_divide(error, F.abs("actual")) * 100, 2).alias(f"{m}_error_percent"),
        ]
    return bt.select(
        series,
        "date",
        F.date_format("date", "EEEE").alias("weekday"),
        rounded(F.col("actual"), 2).alias("actual_revenue"),
        *columns,
        F.col("orders").cast("long").alias("orders"),
        rounded(F.try_divide("actual", F.when(F.col("orders") > 0, F.col("orders"))), 2).alias("aov"),
    )


def _wape(m: str) -> Column:
    return F.try_divide(F.sum(F.abs(F.col("actual") - F.col(m))), F.sum(F.abs("actual"))) * 100


def metrics(bt: DataFrame, series: str = "user_id") -> DataFrame:
    """MAE, RMSE, zero-safe MAPE, WAPE, sMAPE of the main model and the WAPE of all three."""
    error = F.abs(F.col("actual") - F.col("v4_1"))
    both = F.abs("actual") + F.abs("v4_1")
    return bt.groupBy(series).agg(
        F.count(F.lit(1)).alias("evaluation_days"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(F.abs("actual") > 1e-9, F.try_divide(error, F.abs("actual")))) * 100).alias("mape"),
        _wape("v4_1").alias("wape"),
        (F.avg(F.when(both > 1e-9, F.try_divide(error, both))) * 200).alias("smape"),
        _wape("baseline").alias("baseline_wape"),
        _wape("v4").alias("v4_wape"),
    )


def rounded_metrics(m: DataFrame, series: str = "user_id") -> DataFrame:
    names = ["mae", "rmse", "mape", "wape", "smape", "baseline_wape", "v4_wape"]
    return m.select(series, "evaluation_days", *[rounded(F.col(c), 4).alias(c) for c in names])


def comparison(m: DataFrame, series: str = "user_id") -> DataFrame:
    """Improvements in percent and the best model (earlier name in the list on ties)."""
    gain = lambda old, new: rounded(F.try_divide(F.col(old) - F.col(new), F.col(old)) * 100, 2)
    worst = F.lit(float("inf"))
    options = F.array(
        F.struct(F.coalesce("baseline_wape", worst).alias("w"), F.lit(0).alias("k"), F.lit("baseline").alias("name")),
        F.struct(F.coalesce("v4_wape", worst).alias("w"), F.lit(1).alias("k"), F.lit("v4").alias("name")),
        F.struct(F.coalesce("wape", worst).alias("w"), F.lit(2).alias("k"), F.lit("v4_1").alias("name")),
    )
    any_known = F.coalesce("baseline_wape", "v4_wape", "wape").isNotNull()
    return m.select(
        series,
        rounded(F.col("baseline_wape"), 4).alias("baseline_wape"),
        rounded(F.col("v4_wape"), 4).alias("v4_wape"),
        rounded(F.col("wape"), 4).alias("v4_1_wape"),
        gain("baseline_wape", "v4_wape").alias("v4_over_baseline"),
        gain("baseline_wape", "wape").alias("v4_1_over_baseline"),
        gain("v4_wape", "wape").alias("v4_1_over_v4"),
        F.when(any_known, F.array_min(options)["name"]).alias("best_model"),
    )


def reliability(m: DataFrame, series: str = "user_id") -> DataFrame:
    d = F.col("evaluation_days")
    return m.select(
        series,
        "evaluation_days",
        F.when(d >= 14, "reliable").otherwise("limited").alias("status"),
        F.when(d >= 14, "high").when(d >= 7, "medium").otherwise("low").alias("confidence"),
        F.when(d < 14, LIMITED_MESSAGE).alias("message"),
    )


def stored_forecast(points: DataFrame, m: DataFrame, generated_at: str, series: str = "user_id") -> DataFrame:
    """Forecast rows with run metrics, in the shape of the result table."""
    names = ["mae", "rmse", "mape", "wape", "smape"]
    run = m.select(series, "evaluation_days", *[rounded(F.col(c), 4).alias(c) for c in names])
    return (
        points.drop("v4_revenue", "v4_orders", "v4_aov")
        .join(run, series, "left")
        .withColumn("evaluation_days", F.coalesce("evaluation_days", F.lit(0)))
        .withColumn("algorithm", F.lit(model.ALGORITHM))
        .withColumn("model_version", F.lit(model.MODEL_VERSION))
        .withColumn("generated_at", F.lit(generated_at).cast("timestamp"))
    )

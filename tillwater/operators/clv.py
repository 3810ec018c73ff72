"""Customer lifetime value from the shared features, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import clamp, rounded
from tillwater.operators.dashboard import clv_summary

MODEL_VERSION = "behavioral-clv-v1"
# Retention by days since the last order.
RETENTION = [(30, 0.95), (60, 0.85), (90, 0.70), (180, 0.50)]
RETENTION_FLOOR = 0.30


def predict_clv(features: DataFrame, as_of: str, model_version: str = MODEL_VERSION) -> DataFrame:
    """Value = a quarter of past spend + expected spend over the next year.

    Unparsable or negative inputs count as 0; rows without a customer id are skipped.
    """
    clean = features.filter(F.trim(F.col("customer_id").cast("string")) != "")
    for m in ["recency", "frequency", "monetary", "aov", "avg_gap", "tenure"]:
        number = F.col(m).try_cast("double")
        clean = clean.withColumn(m, F.greatest(F.lit(0.0), F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))))
    months = F.greatest(F.col("tenure") / 30.0, F.lit(1.0))
    future_orders = clamp(F.col("frequency") / months * 12.0, 0.0, 24.0)
    retention = F.lit(RETENTION_FLOOR)
    for days, rate in reversed(RETENTION):
        retention = F.when(F.col("recency") <= days, rate).otherwise(retention)
    consistency = F.when(
        F.col("avg_gap") > 0, clamp(F.try_divide(F.lit(90.0), F.col("avg_gap")), 0.5, 1.0)
    ).otherwise(0.60)
    order_value = F.when(F.col("aov") > 0, F.col("aov")).otherwise(
        F.col("monetary") / F.greatest(F.col("frequency"), F.lit(1.0))
    )
    value = F.col("monetary") * 0.25 + future_orders * order_value * retention * consistency
    confidence = F.least(
        F.lit(0.95),
        F.lit(0.55)
        + 0.25 * F.least(F.col("frequency") / 10.0, F.lit(1.0))
        + 0.20 * F.least(F.col("tenure") / 365.0, F.lit(1.0)),
    )
    return clean.select(
        "user_id",
        "customer_id",
        rounded(F.greatest(F.lit(0.0), value), 2).alias("predicted_value"),
        rounded(confidence, 4).alias("confidence_score"),
        F.lit(model_version).alias("model_version"),
        F.lit(as_of).cast("timestamp").alias("prediction_date"),
    )


def clv_run_summary(predictions: DataFrame) -> DataFrame:
    """Totals, exact median, thresholds and top customer of one run."""
    return clv_summary(predictions)

"""Churn scoring: a weighted sum of min-max normalised behaviour features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import clamp, money, rounded
from tillwater.operators.features import MEASURES

# Model weights; measures marked True count against churn (1 - normalised).
WEIGHTS = [
    ("recency", 0.35, False),
    ("frequency", 0.25, True),
    ("monetary", 0.15, True),
    ("avg_gap", 0.15, False),
    ("aov", 0.05, True),
    ("tenure", 0.05, True),
]
HIGH_RISK, MEDIUM_RISK, CHURNED = 0.70, 0.40, 0.50
MODEL_VERSION = "behavioral-churn-v1"


def _normalised(m: str) -> Column:
    low, high = F.col(f"_min_{m}"), F.col(f"_max_{m}")
    scaled = clamp(F.try_divide(F.col(m) - low, high - low), 0.0, 1.0)
    return F.when(high > low, scaled).otherwise(0.0)


def risk_level(probability: Column) -> Column:
    return F.when(probability >= HIGH_RISK, "HIGH").when(probability >= MEDIUM_RISK, "MEDIUM").otherwise("LOW")


def predict_churn(features: DataFrame, as_of: str, model_version: str = MODEL_VERSION) -> DataFrame:
    """Score every customer against the range of its tenant.

    The ranges are a few numbers per tenant joined back by key; adaptive
    execution broadcasts them when their measured size allows.
    """
    ranges = features.groupBy("user_id").agg(
        *[F.min(m).alias(f"_min_{m}") for m in MEASURES], *[F.max(m).alias(f"_max_{m}") for m in MEASURES]
    )
    score = F.lit(0.0)
    for measure, weight, protective in WEIGHTS:
        value = _normalised(measure)
        score = score + F.lit(weight) * ((1.0 - value) if protective else value)
    return (
        features.join(ranges, "user_id")
        .withColumn("churn_probability", rounded(clamp(score, 0.0, 1.0), 4))
        .select(
            "user_id",
            "customer_id",
            "churn_probability",
            risk_level(F.col("churn_probability")).alias("risk_level"),
            (F.col("churn_probability") >= CHURNED).alias("predicted_churn"),
            F.lit(model_version).alias("model_version"),
            F.lit(as_of).cast("timestamp").alias("prediction_date"),
        )
    )


def churn_run_summary(predictions: DataFrame) -> DataFrame:
    """Counts, churn rate and mean probability of one run."""
    return predictions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if("predicted_churn").alias("predicted_churn"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("risk_level") == "LOW").alias("low_risk"),
        money(F.avg(F.col("predicted_churn").cast("int")) * 100).alias("churn_rate"),
        rounded(F.avg(F.col("churn_probability").cast("decimal(18,4)")).cast("double"), 4).alias(
            "average_probability"
        ),
    )

"""Recency / frequency / value features per customer with a completed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import days_between, exact_sum, money, ratio, rounded
from tillwater.operators.dashboard import completed

MEASURES = ["recency", "frequency", "monetary", "aov", "avg_gap", "tenure"]


def reference_date(orders: DataFrame, as_of: str) -> DataFrame:
    """Per tenant the later of ``as_of`` and the newest completed order."""
    return (
        completed(orders)
        .groupBy("user_id")
        .agg(F.greatest(F.lit(as_of).cast("timestamp"), F.max("order_date")).alias("reference_date"))
    )


def customer_features(orders: DataFrame, as_of: str, customers: DataFrame | None = None) -> DataFrame:
    """One shared feature frame; customers without a completed order are dropped.

    The mean gap between consecutive orders telescopes to (last - first) / (n - 1),
    so a single grouped aggregate with map-side combine is enough.
    """
    per_customer = (
        completed(orders)
        .groupBy("user_id", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            exact_sum(F.col("total_amount")).cast("double").alias("_sum"),
            F.min("order_date").alias("_first"),
            F.max("order_date").alias("_last"),
        )
    )
    if customers is not None:
        per_customer = per_customer.join(
            customers.select("user_id", "customer_id"), ["user_id", "customer_id"], "left_semi"
        )
    gap = F.when(
        F.col("frequency") >= 2, days_between(F.col("_last"), F.col("_first")) / (F.col("frequency") - 1)
    ).otherwise(0.0)
    return per_customer.join(reference_date(orders, as_of), "user_id").select(
        "user_id",
        "customer_id",
        rounded(days_between(F.col("reference_date"), F.col("_last")), 2).alias("recency"),
        F.col("frequency").cast("double").alias("frequency"),
        money(F.col("_sum")).alias("monetary"),
        money(ratio(F.col("_sum"), F.col("frequency"))).alias("aov"),
        rounded(gap, 2).alias("avg_gap"),
        rounded(days_between(F.col("reference_date"), F.col("_first")), 2).alias("tenure"),
    )


def segmentation_features(features: DataFrame) -> DataFrame:
    """Tenants need at least two customers to be segmented."""
    enough = features.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    return features.join(enough, "user_id", "left_semi").select(
        "user_id",
        "customer_id",
        "recency",
        "frequency",
        "monetary",
        F.col("aov").alias("average_order_value"),
    )


def churn_features(features: DataFrame) -> DataFrame:
    return features.select(
        "user_id",
        "customer_id",
        F.col("recency").alias("recency_days"),
        F.col("frequency").alias("order_frequency"),
        F.col("monetary").alias("monetary_value"),
        F.col("aov").alias("average_order_value"),
        F.col("avg_gap").alias("average_days_between_orders"),
        F.col("tenure").alias("customer_tenure_days"),
    )


def clv_features(features: DataFrame) -> DataFrame:
    return features.select(
        "user_id",
        "customer_id",
        F.col("recency").alias("recency"),
        F.col("frequency").alias("purchase_frequency"),
        F.col("monetary").alias("total_spent"),
        F.col("aov").alias("average_order_value"),
        F.col("avg_gap").alias("average_order_gap"),
        F.col("tenure").alias("customer_age_days"),
    )

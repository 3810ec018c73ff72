"""Assertions on model results: one row per rule with its number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["user_id", "customer_id"]
# Largest tolerated gap between orders x order value and revenue of a forecast day.
RECONCILE_TOLERANCE = 1.00


class FailedChecks(AssertionError):
    pass


def _as_rows(counts: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("violations")) for n in names])
    return counts.select(F.explode(pairs).alias("_p")).select("_p.*")


def _row_rules(results: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counts = results.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return _as_rows(counts, list(rules))


def _key_rules(results: DataFrame, inputs: DataFrame, known: DataFrame) -> DataFrame:
    """Known customers only, one result per customer, one result per input."""
    unknown = results.join(known.select(*KEYS), KEYS, "left_anti").agg(
        F.lit("unknown_customer").alias("name"), F.count(F.lit(1)).alias("violations")
    )
    per_key = results.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    twice = per_key.agg(
        F.lit("duplicate_customer").alias("name"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")
    )
    absent = inputs.select(*KEYS).join(results.select(*KEYS), KEYS, "left_anti").agg(
        F.lit("missing_result").alias("name"), F.count(F.lit(1)).alias("violations")
    )
    return reduce(DataFrame.unionByName, [unknown, twice, absent])


def churn_checks(results: DataFrame, inputs: DataFrame, known: DataFrame) -> DataFrame:
    rules = {
        "probability_range": F.col("churn_probability").between(0, 1),
        "risk_level": F.col("risk_level").isin("HIGH", "MEDIUM", "LOW"),
        "churn_flag": F.col("predicted_churn").isNotNull(),
    }
    return _key_rules(results, inputs, known).unionByName(_row_rules(results, rules))


def clv_checks(results: DataFrame, inputs: DataFrame, known: DataFrame) -> DataFrame:
    rules = {
        "value_range": F.col("predicted_value") >= 0,
        "confidence_range": F.col("confidence_score").between(0, 1),
    }
    return _key_rules(results, inputs, known).unionByName(_row_rules(results, rules))


def forecast_checks(points: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = {
        "finite_revenue": finite("predicted_revenue"),
        "finite_orders": finite("predicted_orders"),
        "finite_aov": finite("predicted_aov"),
        "reconciles": F.abs(F.col("predicted_orders") * F.col("predicted_aov") - F.col("predicted_revenue"))
        <= RECONCILE_TOLERANCE,
        "bounds": F.col("lower_bound") <= F.col("upper_bound"),
    }
    return _row_rules(points, rules)


def notification_checks(candidates: DataFrame) -> DataFrame:
    """Required fields of notifications."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return _row_rules(candidates, {c: filled(c) for c in ("user_id", "type", "title", "message")})


def require(checks: DataFrame) -> None:
    """Fail the job if any rule is violated. Only the few rule rows reach the driver."""
    failed = checks.filter("violations > 0").collect()
    if failed:
        raise FailedChecks(", ".join(f"{r['name']}: {r['violations']}" for r in failed))

"""Why a forecast day differs from the rest of its forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.functions.ranking import top_per_key
from tillwater.functions.scalars import fixed2, rounded

BAND = 10.0


def _signed(c: Column) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), fixed2(c), F.lit("%"))


def explain_days(points: DataFrame) -> DataFrame:
    """Position, reasons and advice per forecast day, against the means of its series."""
    orders = F.coalesce(F.col("predicted_orders").cast("double"), F.col("expected_orders"))
    # A window over one series: at most a year of days.
    series = W.partitionBy("user_id")
    mean = lambda c: F.coalesce(F.avg(c).over(series), F.lit(0.0))
    df = points.withColumns(
        {
            "_o": orders,
            "_mr": mean(F.col("predicted_revenue")),
            "_mo": mean(orders),
            "_ma": mean(F.col("predicted_aov")),
        }
    )
    revenue, o, a = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("predicted_revenue", "_o", "predicted_aov"))
    mr, mo, ma = F.col("_mr"), F.col("_mo"), F.col("_ma")
    deviation = F.when(mr != 0, F.try_divide(revenue - mr, mr) * 100)
    position = (
        F.when(deviation.isNull(), "unknown").when(deviation >= BAND, "high")
        .when(deviation <= -BAND, "low").otherwise("normal")
    )
    shown = rounded(deviation, 2)
    more_orders, fewer_orders = (mo > 0) & (o > mo * 1.1), (mo > 0) & (o < mo * 0.9)
    dearer, cheaper = (ma > 0) & (a > ma * 1.1), (ma > 0) & (a < ma * 0.9)

    def why(condition: Column, kind: str, subject: str, change: Column, side: str, impact: str) -> Column:
        text = F.concat(F.lit(f"{subject} "), _signed(change), F.lit(f" {side} the forecast-period average."))
        return F.when(condition, F.struct(
            F.lit(kind).alias("type"), text.alias("message"), F.lit(impact).alias("impact")
        ))

    off = lambda x, m: F.try_divide(x - m, m) * 100
    # Reason kinds and texts.
    reasons = F.filter(
        F.array(
            why(position == "high", "revenue-above-average", "Predicted revenue is", shown, "above", "positive"),
            why(position == "low", "revenue-below-average", "Predicted revenue is", shown, "below", "negative"),
            why(more_orders, "higher-demand", "Expected orders are", off(o, mo), "above", "positive"),
            why(fewer_orders, "lower-demand", "Expected orders are", off(o, mo), "below", "negative"),
            why(dearer, "higher-aov", "Predicted AOV is", off(a, ma), "above", "positive"),
            why(cheaper, "lower-aov", "Predicted AOV is", off(a, ma), "below", "negative"),
        ),
        lambda e: e.isNotNull(),
    )
    advice = (
        F.when((position == "high") & more_orders,
               "Prepare inventory and operational capacity for potentially stronger demand.")
        .when((position == "high") & dearer,
              "Consider maintaining premium-product availability and upselling capacity.")
        .when(position == "high",
              "Prepare inventory and promotional capacity for a potentially stronger revenue day.")
        .when((position == "low") & fewer_orders,
              "Consider targeted promotions or customer-retention activity to support demand.")
        .when((position == "low") & cheaper,
              "Consider bundles, upselling, and cross-selling to improve transaction value.")
        .when(position == "low",
              "Consider targeted promotions or retention activity around this lower-revenue day.")
        .otherwise("Monitor the day alongside the overall forecast and adjust operations according to actual demand.")
    )
    return df.select(
        "user_id",
        F.col("forecast_date").alias("date"),
        F.date_format("forecast_date", "EEEE").alias("weekday"),
        rounded(revenue, 2).alias("predicted_revenue"),
        rounded(o, 2).alias("expected_orders"),
        rounded(a, 2).alias("predicted_aov"),
        position.alias("revenue_position"),
        shown.alias("deviation_percent"),
        reasons.alias("reasons"),
        advice.alias("business_implication"),
    )


def first_days(explained: DataFrame, n: int = 7) -> DataFrame:
    return top_per_key(explained, ["user_id"], [F.asc("date")], n).drop("rank")

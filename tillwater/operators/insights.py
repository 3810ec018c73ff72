"""Business insights: a stored forecast set against the recent observed days.

Series are short (at most a year of points), so ranks within a series are
plain windows; everything else is one row per tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.functions.ranking import top_per_key
from tillwater.functions.scalars import exact_sum, fixed2, grouped_in, iso_day, ratio, rounded

WEEK, MONTH = 7, 30
STABLE_BAND = 5.0
PEAK_FACTOR, VOLATILITY, MIN_COVERAGE = 1.25, 1.5, 0.8


def percent_change(current: Column, previous: Column) -> Column:
    """Null where the previous value is 0 or missing."""
    return F.when(previous != 0, F.try_divide(current - previous, F.abs(previous)) * 100)


def direction(change: Column, band: float = STABLE_BAND) -> Column:
    return (
        F.when(change.isNull(), "insufficient-data").when(change > band, "increasing")
        .when(change < -band, "decreasing").otherwise("stable")
    )


def recent_window(daily: DataFrame, days: int = WEEK) -> DataFrame:
    """The last ``days`` observed days of each series; zero-filled days do not count."""
    seen = F.col("observed") if "observed" in daily.columns else (F.col("revenue") > 0) | (F.col("orders") > 0)
    return top_per_key(daily.filter(seen), ["user_id"], [F.desc("date")], days).drop("rank")


def _ranked(points: DataFrame) -> DataFrame:
    return points.withColumn("_rn", F.row_number().over(W.partitionBy("user_id").orderBy("forecast_date")))


def _sum(c: Column) -> Column:
    return exact_sum(c).cast("double")


def revenue_outlook(points: DataFrame) -> DataFrame:
    """Next 7 and 30 days, mean of the latter, peak and lowest day (first on ties)."""
    revenue, rn = F.coalesce("predicted_revenue", F.lit(0.0)), F.col("_rn")
    day = F.struct(F.col("forecast_date").alias("date"), revenue.alias("revenue"))
    agg = _ranked(points).groupBy("user_id").agg(
        _sum(F.when(rn <= WEEK, revenue)).alias("_7"),
        _sum(F.when(rn <= MONTH, revenue)).alias("_30"),
        F.count_if(rn <= MONTH).alias("_n"),
        F.max_by(day, F.struct(revenue, -rn)).alias("_p"),
        F.min_by(day, F.struct(revenue, rn)).alias("_l"),
    )
    return agg.select(
        "user_id",
        rounded(F.col("_7"), 2).alias("next_7_days"),
        rounded(F.col("_30"), 2).alias("next_30_days"),
        rounded(ratio(F.col("_30"), F.col("_n")), 2).alias("average_daily_revenue"),
        F.col("_p.date").alias("peak_date"),
        rounded(F.col("_p.revenue"), 2).alias("peak_revenue"),
        F.col("_l.date").alias("lowest_date"),
        rounded(F.col("_l.revenue"), 2).alias("lowest_revenue"),
    )


def trends(points: DataFrame, daily: DataFrame) -> DataFrame:
    """Demand, order value and revenue of the next week against the last observed week."""
    due = F.coalesce("expected_orders", F.col("predicted_orders").cast("double"), F.lit(0.0))
    ahead = _ranked(points).filter(F.col("_rn") <= WEEK).groupBy("user_id").agg(
        _sum(due).alias("_po"), _sum(F.coalesce("predicted_revenue", F.lit(0.0))).alias("_pr")
    )
    past = recent_window(daily).groupBy("user_id").agg(
        _sum(F.col("orders").cast("double")).alias("_ro"), _sum(F.col("revenue")).alias("_rr")
    )
    both = ahead.join(past, "user_id", "left")
    known = F.col("_ro").isNotNull()
    recent_aov = F.when(F.col("_ro") > 0, F.try_divide("_rr", "_ro"))
    projected_aov = F.when((F.col("_ro") > 0) & (F.col("_po") > 0), F.try_divide("_pr", "_po"))
    changes = {
        "demand": percent_change(F.col("_po"), F.col("_ro")),
        "aov": percent_change(projected_aov, recent_aov),
        "revenue": percent_change(F.col("_pr"), F.col("_rr")),
    }
    out = []
    for name, change in changes.items():
        out += [direction(change).alias(f"{name}_direction"), rounded(change, 2).alias(f"{name}_change")]
    zero_unless = lambda c: rounded(F.when(known, F.col(c)).otherwise(0.0), 2)
    return both.select(
        "user_id",
        *out,
        zero_unless("_ro").alias("recent_orders"),
        zero_unless("_po").alias("projected_orders"),
        rounded(recent_aov, 2).alias("recent_aov"),
        rounded(projected_aov, 2).alias("projected_aov"),
        zero_unless("_rr").alias("recent_revenue"),
        zero_unless("_pr").alias("projected_revenue"),
    )


def _mean(points: DataFrame) -> DataFrame:
    revenue = F.coalesce("predicted_revenue", F.lit(0.0))
    return points.groupBy("user_id").agg(
        (_sum(revenue) / F.count(F.lit(1))).alias("_mean"), F.max(revenue).alias("_max"), F.min(revenue).alias("_min")
    )


def peak_days(points: DataFrame) -> DataFrame:
    """Days at least 25 % above the mean of the forecast, highest first within the tenant."""
    revenue, mean = F.coalesce("predicted_revenue", F.lit(0.0)), F.col("_mean")
    peaks = points.join(_mean(points), "user_id").filter((mean > 0) & (revenue >= mean * PEAK_FACTOR))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("predicted_revenue"), F.asc("forecast_date")))
    return peaks.select(
        "user_id",
        "forecast_date",
        rounded(revenue, 2).alias("predicted_revenue"),
        rounded((revenue - mean) / mean * 100, 2).alias("deviation_percent"),
        place.alias("rank"),
    )


def lowest_days(points: DataFrame, count: int = 2) -> DataFrame:
    """Lowest days of the coming week."""
    week = _ranked(points).filter(F.col("_rn") <= WEEK)
    low = top_per_key(week, ["user_id"], [F.asc(F.coalesce("predicted_revenue", F.lit(0.0))), F.asc("_rn")], count)
    return low.select("user_id", "forecast_date", rounded(F.col("predicted_revenue"), 2).alias("predicted_revenue"), "rank")


def _kept(entries: list[Column]) -> Column:
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def risk_alerts(
    tenants: DataFrame, points: DataFrame, coverage: DataFrame | None = None, spikes: DataFrame | None = None
) -> DataFrame:
    """Risks of each tenant: no forecast, volatility, low coverage of history, spikes in history.

    ``coverage`` has (user_id, coverage); ``spikes`` has (user_id, spike_days).
    """
    df = tenants.select("user_id").distinct().join(_mean(points), "user_id", "left")
    df = df.join(coverage.select("user_id", "coverage"), "user_id", "left") if coverage is not None else (
        df.withColumn("coverage", F.lit(None).cast("double")))
    df = df.join(spikes.select("user_id", "spike_days"), "user_id", "left") if spikes is not None else (
        df.withColumn("spike_days", F.lit(0)))

    def risk(condition: Column, level: str, kind: str, title: str, message: str) -> Column:
        return F.when(condition, F.struct(
            F.lit(level).alias("level"), F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(message).alias("message")
        ))

    some = F.col("_mean").isNotNull()
    volatile = some & (F.col("_mean") > 0) & (F.try_divide(F.col("_max") - F.col("_min"), "_mean") >= VOLATILITY)
    # Risk texts.
    entries = [
        risk(~some, "high", "insufficient-forecast", "Insufficient Forecast Data",
             "No forecast points are available for business analysis."),
        risk(volatile, "medium", "revenue-volatility", "Revenue Volatility",
             "Forecast revenue shows significant variation across the forecast period."),
        risk(some & (F.col("coverage") < MIN_COVERAGE), "medium", "data-coverage", "Limited Data Coverage",
             "Historical data coverage is limited. Forecast-based decisions should be made cautiously."),
        risk(some & (F.col("spike_days") > 0), "low", "historical-spikes", "Historical Revenue Spikes",
             "Recent historical data contains revenue spikes that may increase forecast uncertainty."),
    ]
    return df.select("user_id", F.posexplode(_kept(entries)).alias("_no", "_r")).select(
        "user_id", (F.col("_no") + 1).alias("alert_no"), "_r.*"
    )


def adverse_priority(change: Column) -> Column:
    size = F.abs(change)
    return F.when(size > 20, "high").when(size >= 10, "medium").otherwise("low")


def _rupees(c: Column) -> Column:
    return F.concat(F.lit("₹"), grouped_in(c))


def recommendations(
    outlook: DataFrame, trend: DataFrame, peaks: DataFrame, lows: DataFrame, risks: DataFrame
) -> DataFrame:
    """Rule-based advice, by priority and then rule order."""
    day = F.struct("rank", iso_day(F.col("forecast_date")).alias("date"), "predicted_revenue", *(
        ["deviation_percent"] if "deviation_percent" in peaks.columns else []))
    top = peaks.groupBy("user_id").agg(F.array_sort(F.collect_list(day)).alias("peaks"))
    low_day = F.struct("rank", iso_day(F.col("forecast_date")).alias("date"), "predicted_revenue")
    low = lows.groupBy("user_id").agg(F.array_sort(F.collect_list(low_day)).alias("lows"))
    high_risk = risks.groupBy("user_id").agg(F.bool_or(F.col("level") == "high").alias("high_risk"))
    tenants = risks.select("user_id").unionByName(outlook.select("user_id")).distinct()
    df = (
        tenants.join(outlook, "user_id", "left").join(trend, "user_id", "left").join(top, "user_id", "left")
        .join(low, "user_id", "left").join(high_risk, "user_id", "left")
    )
    no_dates = F.array().cast("array<string>")
    low_dates = F.coalesce(F.transform("lows", lambda d: d["date"]), no_dates)
    low_texts = F.transform(
        "lows", lambda d: F.concat(d["date"], F.lit(" ("), _rupees(d["predicted_revenue"]), F.lit(")"))
    )
    peak_date, peak_revenue = iso_day(F.col("peak_date")), F.col("peak_revenue")

    def rule(condition, priority, category, title, metric, change, text, dates) -> Column:
        return F.when(condition, F.struct(
            priority.alias("priority"), F.lit(category).alias("category"), F.lit(title).alias("title"),
            F.lit(metric).cast("string").alias("metric"), change.cast("double").alias("change_percent"),
            text.alias("recommendation"), dates.alias("supporting_dates"),
        ))

    def down(c: str) -> Column:
        return (F.col(f"{c}_direction") == "decreasing") & F.col(f"{c}_change").isNotNull()

    def up(c: str) -> Column:
        return (F.col(f"{c}_direction") == "increasing") & F.col(f"{c}_change").isNotNull()

    def gain(c: str) -> Column:
        return F.when(F.col(f"{c}_change") > 20, "high").otherwise("medium")

    def size(c: str) -> Column:
        return fixed2(F.abs(f"{c}_change"))

    revenue, demand, aov = F.col("revenue_change"), F.col("demand_change"), F.col("aov_change")
    first_peak = F.get("peaks", F.lit(0))
    none = F.lit(None)
    low_part = F.when(
        F.size(low_dates) > 0, F.concat(F.lit(" Prioritize attention around "), F.array_join(low_texts, " and "), F.lit("."))
    ).otherwise("")
    peak_part = F.when(
        peak_date.isNotNull() & (peak_revenue != 0),
        F.concat(F.lit(" The highest forecast day is "), peak_date, F.lit(", with predicted revenue of "),
                 _rupees(peak_revenue), F.lit(".")),
    ).otherwise("")
    # Categories, titles and texts of the advice.
    rules = [
        rule(down("revenue"), adverse_priority(revenue), "revenue-risk", "Revenue Decline Risk", "revenue", revenue,
             F.concat(F.lit("Forecast revenue is "), size("revenue"),
                      F.lit("% below recent observed revenue. Review demand-generation and conversion strategies before "
                            "the forecast period."), low_part), low_dates),
        rule(up("revenue"), gain("revenue"), "revenue-opportunity", "Revenue Growth Opportunity", "revenue", revenue,
             F.concat(F.lit("Forecast revenue is "), fixed2(revenue),
                      F.lit("% above recent observed revenue. Prepare inventory, staffing, and operational capacity to "
                            "capitalize on the expected growth."), peak_part),
             F.when(peak_date.isNotNull(), F.array(peak_date)).otherwise(no_dates)),
        rule(down("demand"), adverse_priority(demand), "demand-risk", "Demand Decline Risk", "orders", demand,
             F.concat(F.lit("Forecast order volume is "), size("demand"),
                      F.lit("% below recent observed demand. Consider targeted promotional and customer-retention "
                            "campaigns, especially around "),
                      F.when(F.size(low_dates) > 0, F.array_join(low_dates, " and ")).otherwise(
                          "the lowest-demand forecast days"), F.lit(".")), low_dates),
        rule(up("demand"), gain("demand"), "demand-opportunity", "Demand Growth Opportunity", "orders", demand,
             F.concat(F.lit("Forecast order volume is "), fixed2(demand),
                      F.lit("% above recent observed demand. Increase inventory readiness, staffing capacity, and "
                            "operational preparation for the expected increase in demand.")), no_dates),
        rule(down("aov"), adverse_priority(aov), "aov-risk", "Average Order Value Risk", "aov", aov,
             F.concat(F.lit("Forecast average order value is "), size("aov"),
                      F.lit("% below the recent observed AOV. Consider bundles, upselling, cross-selling, and "
                            "premium-product recommendations to increase transaction value.")), no_dates),
        rule(up("aov"), gain("aov"), "aov-opportunity", "Average Order Value Opportunity", "aov", aov,
             F.concat(F.lit("Forecast average order value is "), fixed2(aov),
                      F.lit("% above recent observed AOV. Prioritize premium products, bundles, and higher-value customer "
                            "segments to capitalize on the expected increase.")), no_dates),
        rule(first_peak.isNotNull(), F.lit("high"), "peak-demand", "Forecast Peak-Day Opportunity", "predictedRevenue",
             first_peak["deviation_percent"],
             F.concat(F.lit("Prepare additional inventory, staffing, and marketing support for "), first_peak["date"],
                      F.lit(", which has forecast revenue of "), _rupees(first_peak["predicted_revenue"]),
                      F.lit(", approximately "), fixed2(F.abs(first_peak["deviation_percent"])),
                      F.lit("% above the forecast-period average.")),
             F.transform(F.slice("peaks", 1, 3), lambda d: d["date"])),
        rule(F.col("high_risk"), F.lit("high"), "forecast-risk", "Forecast Reliability Risk", None, none,
             F.lit("Use conservative planning because the current forecast contains a high-risk data or forecast-quality "
                   "condition. Validate major business decisions against additional observed sales information."), no_dates),
        rule((F.col("next_7_days") > 0) & (F.col("next_30_days") > 0), F.lit("low"), "planning", "Forecast-Based Planning",
             None, none,
             F.lit("Use the 7-day revenue outlook for short-term operational planning and the 30-day outlook for broader "
                   "business planning."), no_dates),
    ]
    numbered = [F.when(r.isNotNull(), F.struct(F.lit(i).alias("rule_no"), r.alias("rule"))) for i, r in enumerate(rules, 1)]
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("_rank"), F.asc("rule_no")))
    return (
        df.select("user_id", F.explode(_kept(numbered)).alias("_e"))
        .select("user_id", "_e.rule_no", "_e.rule.*")
        .withColumn("_rank", rank)
        .withColumn("place", place)
        .drop("_rank", "rule_no")
    )


def insights(points: DataFrame, daily: DataFrame, coverage: DataFrame, spikes: DataFrame) -> dict[str, DataFrame]:
    """All insight sections for all tenants of the history."""
    outlook, trend, peaks = revenue_outlook(points), trends(points, daily), peak_days(points)
    risks = risk_alerts(daily, points, coverage, spikes)
    return {
        "outlook": outlook,
        "trends": trend,
        "peak_days": peaks,
        "risks": risks,
        "recommendations": recommendations(outlook, trend, peaks, lowest_days(points), risks),
    }

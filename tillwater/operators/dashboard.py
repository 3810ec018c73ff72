"""Dashboard reads over the canonical tables, for all tenants at once.

Every frame is keyed by ``user_id``. Totals per tenant are joined back by key
instead of being taken with a tenant-wide window, so a tenant holding most of
the rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.quantiles import exact_median
from tillwater.functions.ranking import latest_per_key, top_per_key
from tillwater.functions.scalars import exact_sum, iso_day, money, order_key, ratio, rounded
from tillwater.session import stored

COMPLETED = "completed"
# Display defaults.
UNKNOWN_PRODUCT, UNCATEGORIZED, UNCLASSIFIED, UNKNOWN_CUSTOMER = (
    "Unknown Product", "Uncategorized", "Unclassified", "Unknown Customer",
)
RISK_LEVELS = ["HIGH", "MEDIUM", "LOW"]
# A customer is of high value from this multiple of the mean predicted value on.
HIGH_VALUE_FACTOR = 1.5


def completed(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == COMPLETED)


def summary_kpis(customers: DataFrame, products: DataFrame, orders: DataFrame, churn: DataFrame) -> DataFrame:
    """Customer, product and order counts, revenue, order value, churn rate per tenant."""
    n_customers = customers.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_customers"))
    n_products = products.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_products"))
    sales = completed(orders).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"), exact_sum(F.col("total_amount")).cast("double").alias("revenue")
    )
    risk = churn_rates(churn)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        n_customers.join(n_products, "user_id", "full_outer")
        .join(sales, "user_id", "full_outer")
        .join(risk, "user_id", "left")
        .select(
            "user_id",
            zero("total_customers").alias("total_customers"),
            zero("total_products").alias("total_products"),
            zero("total_orders").alias("total_orders"),
            money(F.col("revenue")).alias("total_revenue"),
            money(ratio(F.col("revenue"), F.col("total_orders"))).alias("average_order_value"),
            money(ratio(F.col("revenue"), F.col("total_customers"))).alias("revenue_per_customer"),
            money(F.col("churn_rate")).alias("churn_rate"),
            zero("high_risk").alias("high_risk_customers"),
        )
    )


def latest_churn(churn: DataFrame) -> DataFrame:
    return latest_per_key(churn, ["user_id", "customer_id"], "prediction_date", ["churn_probability", "risk_level"])


def churn_rates(churn: DataFrame) -> DataFrame:
    """Share of customers whose latest prediction is churn, in percent."""
    return latest_churn(churn).groupBy("user_id").agg(
        (F.avg(F.col("predicted_churn").cast("int")) * 100).alias("churn_rate"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
    )


def monthly_revenue(orders: DataFrame, year: int | None = None) -> DataFrame:
    """Twelve zero-filled months of one year (the latest with sales unless given)."""
    by_month = (
        completed(orders)
        .groupBy("user_id", F.year("order_date").alias("year"), F.month("order_date").alias("month"))
        .agg(exact_sum(F.col("total_amount")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    if year is not None and not 2000 <= year <= 2100:
        raise ValueError("year must lie in 2000..2100")
    # The months of a tenant are few: one row per tenant holds them, and the spine looks them up.
    month = F.struct(F.col("year") * 100 + F.col("month"), F.struct("revenue", "orders").alias("v"))
    tenants = by_month.groupBy("user_id").agg(
        (F.max("year") if year is None else F.lit(year)).alias("year"),
        F.map_from_entries(F.collect_list(month)).alias("_months"),
    )
    spine = tenants.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn(
        "_v", F.try_element_at("_months", F.col("year") * 100 + F.col("month"))
    )
    return spine.select(
        "user_id",
        F.col("year").cast("long").alias("year"),
        F.col("month").cast("long").alias("month"),
        money(F.col("_v.revenue")).alias("revenue"),
        F.coalesce("_v.orders", F.lit(0)).alias("orders"),
    )


def available_years(orders: DataFrame) -> DataFrame:
    years = completed(orders).select("user_id", F.year("order_date").cast("long").alias("year")).distinct()
    return years.orderBy("user_id", F.desc("year"))


def monthly_summary(months: DataFrame) -> DataFrame:
    """Year total, active months, both monthly means and the best month (earliest on ties)."""
    active = F.col("revenue") > 0
    return (
        months.groupBy("user_id", "year")
        .agg(
            exact_sum(F.col("revenue")).cast("double").alias("_total"),
            F.count_if(active).alias("active_months"),
            F.max_by(F.struct("month", "revenue"), F.struct(F.col("revenue"), -F.col("month"))).alias("_best"),
        )
        .select(
            "user_id",
            "year",
            money(F.col("_total")).alias("total_revenue"),
            "active_months",
            money(F.col("_total") / 12).alias("average_monthly_revenue"),
            money(ratio(F.col("_total"), F.col("active_months"))).alias("average_active_month_revenue"),
            F.when(F.col("_best.revenue") > 0, F.col("_best.month")).alias("best_month"),
            money(F.col("_best.revenue")).alias("best_month_revenue"),
        )
    )


def product_performance(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity, revenue, distinct orders, selling price and revenue share per sold product.

    Revenue is recomputed per line; the (tenant, product) sums are small next
    to the lines, so the catalogue is joined only after the aggregation.
    """
    line = F.greatest(F.lit(0.0), F.col("quantity") * F.col("unit_price") - F.col("discount"))
    # Sum per (product, order) first: the distinct order count then needs no second pass over lines.
    per_order = (
        items.join(completed(orders).select("user_id", "order_id"), order_key(items))
        .groupBy("user_id", "product_id", "order_id")
        .agg(exact_sum(line).alias("_rev"), F.sum("quantity").alias("_qty"))
    )
    # Needed per product and per tenant: written once, so the lines are joined once.
    sold = stored(
        per_order.groupBy("user_id", "product_id").agg(
            F.sum("_qty").alias("quantity_sold"),
            F.sum("_rev").cast("double").alias("_revenue"),
            F.count(F.lit(1)).alias("order_count"),
        )
    )
    totals = sold.groupBy("user_id").agg(F.sum(F.col("_revenue").cast("decimal(28,6)")).cast("double").alias("_all"))
    # One row a tenant: a shuffled join would gather a tenant's products in one task.
    return (
        sold.join(F.broadcast(totals), "user_id")
        .join(products.select("user_id", "product_id", "name", "category"), ["user_id", "product_id"], "left")
        .select(
            "user_id",
            "product_id",
            F.coalesce("name", F.lit(UNKNOWN_PRODUCT)).alias("name"),
            F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"),
            "quantity_sold",
            "order_count",
            money(F.col("_revenue")).alias("revenue"),
            money(ratio(F.col("_revenue"), F.col("quantity_sold"))).alias("average_selling_price"),
            money(ratio(F.col("_revenue"), F.col("_all")) * 100).alias("revenue_share"),
        )
        .orderBy(F.desc("revenue"), "user_id", "product_id")
    )


def product_performance_summary(performance: DataFrame) -> DataFrame:
    top = F.max_by(F.struct("product_id", "name", "revenue"), F.struct(F.col("revenue"), -F.col("product_id")))
    return (
        performance.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            exact_sum(F.col("revenue")).cast("double").alias("total_revenue"),
            top.alias("_top"),
        )
        .select(
            "user_id",
            "total_products",
            money(F.col("total_revenue")).alias("total_revenue"),
            F.col("_top.product_id").alias("top_product_id"),
            F.col("_top.name").alias("top_product_name"),
            F.col("_top.revenue").alias("top_product_revenue"),
        )
    )


def customer_distribution(segments: DataFrame) -> DataFrame:
    """Customers per latest segment, with the share of the tenant's customers."""
    latest = latest_per_key(segments, ["user_id", "customer_id"], "created_at", ["segment_name"])
    counts = latest.groupBy(
        "user_id", F.coalesce("segment_name", F.lit(UNCLASSIFIED)).alias("segment")
    ).agg(F.count(F.lit(1)).alias("customers"))
    totals = counts.groupBy("user_id").agg(F.sum("customers").alias("_all"))
    return counts.join(totals, "user_id").select(
        "user_id", "segment", "customers", money(ratio(F.col("customers"), F.col("_all")) * 100).alias("percentage")
    ).orderBy("user_id", F.desc("customers"), "segment")


def dominant_segment(distribution: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("segment", "customers", "percentage"), F.struct("customers", "segment"))
    return distribution.groupBy("user_id").agg(best.alias("_s")).select("user_id", "_s.*")


def recent_orders(orders: DataFrame, items: DataFrame, customers: DataFrame, limit: int = 10) -> DataFrame:
    """Newest orders of each tenant, any status. The limit is taken before any join."""
    limit = max(1, min(100, limit))
    newest = top_per_key(orders, ["user_id"], [F.desc("order_date"), F.desc("order_id")], limit)
    key = order_key(items)
    line_counts = (
        items.join(newest.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("item_count"))
    )
    return (
        newest.join(line_counts, key, "left")
        .join(customers.select("user_id", "customer_id", "name", "country"), ["user_id", "customer_id"], "left")
        .select(
            "user_id",
            F.col("rank").cast("long").alias("rank"),
            "order_id",
            "customer_id",
            F.coalesce("name", F.lit(UNKNOWN_CUSTOMER)).alias("customer_name"),
            "country",
            "status",
            money(F.col("total_amount")).alias("total_amount"),
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            iso_day(F.col("order_date")).alias("order_day"),
        )
    )


def latest_clv(clv: DataFrame) -> DataFrame:
    return latest_per_key(clv, ["user_id", "customer_id"], "prediction_date", ["predicted_value", "confidence_score"])


def clv_summary(clv: DataFrame) -> DataFrame:
    """Totals, exact median, thresholds and top customer over the latest value per customer."""
    latest = stored(latest_clv(clv).withColumn("predicted_value", money(F.col("predicted_value"))))
    base = latest.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("customer_count"),
        exact_sum(F.col("predicted_value")).cast("double").alias("_total"),
        rounded(F.avg(F.round("confidence_score", 4).cast("decimal(18,4)")).cast("double"), 4).alias("_confidence"),
        F.max_by(
            F.struct("customer_id", "predicted_value"), F.struct(F.col("predicted_value"), F.col("customer_id"))
        ).alias("_top"),
        F.max_by("model_version", F.col("prediction_date")).alias("model_version"),
    ).withColumn("_mean", F.col("_total") / F.col("customer_count"))
    marks = (
        latest.join(base.select("user_id", "_mean"), "user_id")
        .groupBy("user_id")
        .agg(
            F.count_if(
                (F.col("_mean") > 0) & (F.col("predicted_value") >= F.col("_mean") * HIGH_VALUE_FACTOR)
            ).alias("high_value_customers"),
            F.count_if(F.col("predicted_value") >= F.col("_mean")).alias("above_average_customers"),
        )
    )
    median = exact_median(latest, ["user_id"], "predicted_value", "_median")
    return base.join(marks, "user_id").join(median, "user_id").select(
        "user_id",
        "customer_count",
        money(F.col("_total")).alias("total_predicted_value"),
        money(F.col("_mean")).alias("average_predicted_value"),
        money(F.col("_median")).alias("median_predicted_value"),
        F.coalesce("_confidence", F.lit(0.0)).alias("average_confidence_score"),
        "high_value_customers",
        "above_average_customers",
        F.col("_top.customer_id").alias("top_customer_id"),
        F.col("_top.predicted_value").alias("top_customer_value"),
        "model_version",
    )


def clv_list(clv: DataFrame, customers: DataFrame) -> DataFrame:
    return (
        latest_clv(clv)
        .join(customers.select("user_id", "customer_id", "name"), ["user_id", "customer_id"], "left")
        .select(
            "user_id",
            "customer_id",
            F.coalesce("name", F.lit(UNKNOWN_CUSTOMER)).alias("customer_name"),
            money(F.col("predicted_value")).alias("predicted_value"),
            rounded(F.col("confidence_score"), 4).alias("confidence_score"),
        )
        .orderBy(F.desc("predicted_value"), "user_id", "customer_id")
    )


def churn_summary(churn: DataFrame) -> DataFrame:
    """Counts per risk, churn rate and mean probability over the latest predictions."""
    return latest_churn(churn).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("risk_level") == "LOW").alias("low_risk"),
        F.count_if("predicted_churn").alias("predicted_churn_customers"),
        money(F.avg(F.col("predicted_churn").cast("int")) * 100).alias("churn_rate"),
        rounded(F.avg(F.col("churn_probability").cast("decimal(18,4)")).cast("double"), 4).alias(
            "average_probability"
        ),
    )


def risk_distribution(churn: DataFrame) -> DataFrame:
    """Three fixed rows per tenant (HIGH, MEDIUM, LOW) with counts and percentages."""
    latest = latest_churn(churn)
    counts = latest.groupBy("user_id", "risk_level").agg(F.count(F.lit(1)).alias("_n"))
    tenants = counts.groupBy("user_id").agg(F.sum("_n").alias("_all"))
    spine = tenants.withColumn("risk_level", F.explode(F.array(*[F.lit(r) for r in RISK_LEVELS])))
    return spine.join(counts, ["user_id", "risk_level"], "left").select(
        "user_id",
        "risk_level",
        F.coalesce("_n", F.lit(0)).alias("customers"),
        money(ratio(F.col("_n"), F.col("_all")) * 100).alias("percentage"),
    )


def churn_list(churn: DataFrame, customers: DataFrame) -> DataFrame:
    return (
        latest_churn(churn)
        .join(customers.select("user_id", "customer_id", "name"), ["user_id", "customer_id"], "left")
        .select(
            "user_id",
            "customer_id",
            F.coalesce("name", F.lit(UNKNOWN_CUSTOMER)).alias("customer_name"),
            rounded(F.col("churn_probability"), 4).alias("churn_probability"),
            money(F.col("churn_probability") * 100).alias("churn_percentage"),
            "risk_level",
            "predicted_churn",
        )
        .orderBy(F.desc("churn_probability"), "user_id", "customer_id")
    )


def activity_feed(
    datasets: DataFrame,
    orders: DataFrame,
    runs: list[tuple[str, DataFrame, str]],
    limit: int = 10,
) -> DataFrame:
    """Newest events of each tenant: three datasets, three orders, the last run of each model.

    ``runs`` holds (kind, frame, timestamp column) for segmentation, churn and forecast.
    """
    # Titles and descriptions of model runs.
    run_texts = {
        "segmentation": (
            "Customer segmentation completed", "Customer segmentation model results were generated."
        ),
        "churn": ("Churn prediction completed", "Customer churn probabilities were updated."),
        "forecast": ("Sales forecast generated", "Revenue forecasting results were updated."),
    }
    ds = top_per_key(datasets, ["user_id"], [F.desc("uploaded_at"), F.desc("dataset_id")], 3).select(
        "user_id",
        F.concat(F.lit("dataset-"), "dataset_id").alias("id"),
        F.lit("dataset").alias("type"),
        F.lit("Dataset imported").alias("title"),
        F.concat("name", F.lit(" — "), F.coalesce("row_count", F.lit(0)).cast("string"), F.lit(" rows")).alias(
            "description"
        ),
        F.col("uploaded_at").alias("timestamp"),
    )
    amount = F.regexp_replace(money(F.col("total_amount")).cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
    recent = top_per_key(orders, ["user_id"], [F.desc("order_date"), F.desc("order_id")], 3).select(
        "user_id",
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("id"),
        F.lit("order").alias("type"),
        F.lit("Order processed").alias("title"),
        F.concat(F.col("order_id").cast("string"), F.lit(" — "), amount).alias("description"),
        F.col("order_date").alias("timestamp"),
    )
    feed = ds.unionByName(recent)
    for kind, frame, ts in runs:
        title, text = run_texts[kind]
        feed = feed.unionByName(
            frame.groupBy("user_id")
            .agg(F.max(ts).alias("timestamp"))
            .select(
                "user_id",
                F.lit(f"{kind}-latest").alias("id"),
                F.lit(kind).alias("type"),
                F.lit(title).alias("title"),
                F.lit(text).alias("description"),
                "timestamp",
            )
        )
    return top_per_key(feed, ["user_id"], [F.desc("timestamp"), F.asc("id")], limit)


def daily_revenue(orders: DataFrame) -> DataFrame:
    """Zero-filled days from the first to the last completed order of each tenant."""
    by_day = (
        completed(orders)
        .groupBy("user_id", F.to_date("order_date").alias("day"))
        .agg(exact_sum(F.col("total_amount")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    return filled_days(by_day, "user_id", "day", ["revenue", "orders"]).select(
        "user_id", "day", money(F.col("revenue")).alias("revenue"), F.coalesce("orders", F.lit(0)).alias("orders")
    )


def filled_days(
    by_day: DataFrame, series: str, day: str, values: list[str], start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Every day from ``start`` to ``end`` (default: first to last) of each series, nulls where it has none.

    The days of a series are gathered into a map, whose size is its calendar
    span, and looked up along the calendar: no second pass over the facts.
    """
    entry = F.struct(F.col(day), F.struct(*values).alias("_v"))
    spans = by_day.groupBy(series).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_days"), F.min(day).alias("_a"), F.max(day).alias("_z")
    )
    calendar = F.sequence(F.col("_a") if start is None else start, F.col("_z") if end is None else end)
    filled = spans.select(series, "_days", F.explode(calendar).alias(day)).withColumn(
        "_v", F.try_element_at("_days", F.col(day))
    )
    return filled.select(series, day, *[F.col(f"_v.{c}").alias(c) for c in values])


def evaluation_labels(evaluation_days: Column) -> tuple[Column, Column]:
    """(reliability, confidence) of a stored forecast from its scored days."""
    d = evaluation_days
    reliability = (
        F.when(d.isNull(), "unknown").when(d < 7, "insufficient").when(d < 14, "limited").otherwise("reliable")
    )
    confidence = F.when(d.isNull(), "unknown").when(d < 14, "low").when(d < 30, "medium").otherwise("high")
    return reliability, confidence


def history_quality(orders: DataFrame) -> DataFrame:
    """Coverage of the calendar span by distinct order days."""
    days = orders.select("user_id", F.to_date("order_date").alias("day")).filter("day is not null").distinct()
    span = days.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("observed_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("calendar_days"),
    )
    coverage = F.col("observed_days") / F.col("calendar_days")
    return span.select(
        "user_id",
        "observed_days",
        "calendar_days",
        (F.col("calendar_days") - F.col("observed_days")).alias("missing_days"),
        rounded(coverage, 4).alias("coverage"),
        F.when(F.col("observed_days") == 1, "insufficient")
        .when(coverage >= 0.9, "high")
        .when(coverage >= 0.7, "medium")
        .otherwise("low")
        .alias("quality"),
    )


def dataset_list(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy("user_id", F.desc("uploaded_at"), F.desc("dataset_id"))


def latest_dataset(datasets: DataFrame) -> DataFrame:
    """Id of the newest completed dataset per tenant, used to tag model results."""
    return (
        datasets.filter(F.col("status") == COMPLETED)
        .groupBy("user_id")
        .agg(F.max_by("dataset_id", F.struct("uploaded_at", "dataset_id")).alias("dataset_id"))
    )


def recommendation_list(recs: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    return (
        recs.join(customers.select("user_id", "customer_id", F.col("name").alias("customer_name")),
                  ["user_id", "customer_id"], "left")
        .join(products.select("user_id", "product_id", F.col("name").alias("product_name"), "category"),
              ["user_id", "product_id"], "left")
        .select(
            "user_id",
            "customer_id",
            F.coalesce("customer_name", F.lit(UNKNOWN_CUSTOMER)).alias("customer_name"),
            "product_id",
            F.coalesce("product_name", F.lit(UNKNOWN_PRODUCT)).alias("product_name"),
            F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"),
            "score",
            "reason",
        )
        .orderBy(F.desc("score"), "user_id", "customer_id", "product_id")
    )


def recommendation_summary(recs: DataFrame) -> DataFrame:
    return recs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.count_distinct("customer_id").alias("customers"),
        rounded(F.avg(F.col("score").cast("decimal(18,4)")).cast("double"), 4).alias("average_score"),
        F.max("score").alias("max_score"),
    )


def forecast_chart(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Historical days and forecast points in one series; metadata rides on every forecast point."""
    past = history.select(
        "user_id",
        F.col("day").alias("date"),
        F.lit("history").alias("kind"),
        F.col("revenue").alias("revenue"),
        F.col("orders").cast("double").alias("orders"),
    )
    future = forecast.select(
        "user_id",
        F.col("forecast_date").alias("date"),
        F.lit("forecast").alias("kind"),
        F.col("predicted_revenue").alias("revenue"),
        F.col("predicted_orders").cast("double").alias("orders"),
        "lower_bound",
        "upper_bound",
    )
    return past.unionByName(future, allowMissingColumns=True)


def forecast_metadata(forecast: DataFrame) -> DataFrame:
    """Horizon and model metadata taken from the last forecast point of each tenant."""
    meta = ["model_version", "algorithm", "evaluation_days", "mae", "rmse", "mape", "wape", "smape"]
    reliability, confidence = evaluation_labels(F.col("evaluation_days"))
    return (
        forecast.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("horizon"),
            exact_sum(F.col("predicted_revenue")).cast("double").alias("total_predicted_revenue"),
            F.max_by(F.struct(*meta), F.col("forecast_date")).alias("_m"),
        )
        .select("user_id", "horizon", money(F.col("total_predicted_revenue")).alias("total_predicted_revenue"), "_m.*")
        .withColumn("evaluation_status", reliability)
        .withColumn("evaluation_confidence", confidence)
    )

"""Ad hoc analyst reads and the list views of the browser, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.functions.ranking import top_per_key
from tillwater.functions.scalars import clamp, exact_sum, iso_day, money, order_key, ratio
from tillwater.operators.dashboard import completed


def provenance_split(orders: DataFrame, synthetic_pattern: str, by: list[str] | None = None) -> DataFrame:
    """Completed orders and revenue split by whether the order id matches a pattern."""
    synthetic = F.col("order_id").cast("string").rlike(synthetic_pattern)
    amount = F.col("total_amount")
    out = completed(orders).groupBy(*(by or ["user_id"])).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(synthetic).alias("synthetic_orders"),
        money(exact_sum(F.when(synthetic, amount)).cast("double")).alias("synthetic_revenue"),
        money(exact_sum(F.when(~synthetic, amount)).cast("double")).alias("real_revenue"),
    )
    return out.withColumn(
        "synthetic_share", money(ratio(F.col("synthetic_orders"), F.col("orders")) * 100)
    )


def orders_with_prefix(orders: DataFrame, prefixes: list[str]) -> DataFrame:
    hit = reduce(lambda a, b: a | b, [F.col("order_id").cast("string").startswith(p) for p in prefixes])
    return orders.filter(hit).select(
        "user_id", "order_id", "status", money(F.col("total_amount")).alias("total_amount"),
        iso_day(F.col("order_date")).alias("order_day"),
    ).orderBy("order_day", "order_id")


def order_drilldown(orders: DataFrame, items: DataFrame, customers: DataFrame, start: str, end: str) -> DataFrame:
    """Orders of a date range with customer and line detail, one row per line."""
    ranged = orders.filter((F.col("order_date") >= F.lit(start).cast("timestamp"))
                           & (F.col("order_date") < F.lit(end).cast("timestamp")))
    return (
        ranged.join(items, order_key(items), "left")
        .join(customers.select("user_id", "customer_id", "name"), ["user_id", "customer_id"], "left")
        .select(
            "user_id", "order_id", iso_day(F.col("order_date")).alias("order_day"), "status", "customer_id",
            F.col("name").alias("customer_name"), "product_id", "quantity",
            money(F.col("total_price")).alias("total_price"),
        )
    )


def order_days(orders: DataFrame) -> DataFrame:
    """Daily order history: orders and revenue per distinct day, all statuses."""
    return orders.groupBy("user_id", iso_day(F.col("order_date")).alias("day")).agg(
        F.count(F.lit(1)).alias("orders"),
        money(exact_sum(F.col("total_amount")).cast("double")).alias("revenue"),
    )


def table_counts(tables: dict[str, DataFrame], by: str = "user_id") -> DataFrame:
    counts = [
        df.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("orders"))


def nested_orders(orders: DataFrame, items: DataFrame, products: DataFrame, order_ids: list | None = None) -> DataFrame:
    """One row per order with its lines as an array of structs, ordered by product."""
    chosen = orders if order_ids is None else orders.filter(F.col("order_id").isin(order_ids))
    key = order_key(items)
    lines = (
        items.join(chosen.select("user_id", "order_id"), key)
        .join(products.select("user_id", "product_id", "name"), ["user_id", "product_id"], "left")
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("product_id", "name", "quantity", money(F.col("total_price")).alias("total")))
            ).alias("items")
        )
    )
    return chosen.join(lines, key, "left").select(
        "user_id", "order_id", iso_day(F.col("order_date")).alias("order_day"), "items"
    )


def product_listing(products: DataFrame) -> DataFrame:
    return products.select("user_id", "product_id", "name", "category", "price").orderBy("user_id", "name", "product_id")


def top_customers(predictions: DataFrame, measure: str, n: int = 20) -> DataFrame:
    """Largest ``n`` customers of each tenant by a score."""
    ranked = top_per_key(predictions, ["user_id"], [F.desc(measure), F.asc("customer_id")], n)
    return ranked.select("user_id", F.col("rank").cast("long").alias("rank"), "customer_id", measure)


def as_percentage(value: Column) -> Column:
    """Ratios (at most 1) become percent, percents stay; the result lies in 0..100."""
    v = F.coalesce(value, F.lit(0.0))
    return clamp(F.when(v <= 1, v * 100).otherwise(v), 0.0, 100.0)


def risk_label(risk: Column, probability: Column) -> Column:
    """Stored risk level, else one derived from the percentage."""
    pct = as_percentage(probability)
    derived = F.when(pct >= 70, "HIGH").when(pct >= 40, "MEDIUM").otherwise("LOW")
    return F.coalesce(F.upper(F.nullif(F.trim(risk), F.lit(""))), derived)


def customers_with_recommendations(recs: DataFrame, customers: DataFrame, term: str = "") -> DataFrame:
    """Customers having recommendations with their count, by name; optional substring search."""
    counts = recs.groupBy("user_id", "customer_id").agg(F.count(F.lit(1)).alias("recommendations"))
    out = counts.join(customers, ["user_id", "customer_id"])
    if term.strip():
        needle = F.lit(term.strip().lower())
        hay = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
               for c in ("name", "email") if c in customers.columns]
        out = out.filter(reduce(lambda a, b: a | b, hay))
    return out.select("user_id", "customer_id", "name", "recommendations").orderBy("name", "customer_id")


def customer_recommendations(
    recs: DataFrame, products: DataFrame, customer_id, sort: str = "score", n: int | None = 5
) -> DataFrame:
    """One customer's recommendations by score, price ascending or price descending."""
    order = {"score": F.desc("score"), "price_asc": F.asc("price"), "price_desc": F.desc("price")}[sort]
    mine = recs.filter(F.col("customer_id") == F.lit(customer_id)).join(
        products.select("user_id", "product_id", "name", "category", "price"), ["user_id", "product_id"], "left"
    ).orderBy(order, F.asc("product_id"))
    return mine if n is None else mine.limit(n)


def last_days(daily: DataFrame, n: int, key: str = "user_id", day: str = "day") -> DataFrame:
    """The last ``n`` days of each series."""
    w = W.partitionBy(key).orderBy(F.desc(day))
    return daily.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of an ordered listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def next_week(forecast: DataFrame) -> DataFrame:
    """Revenue, orders and order value of the first seven forecast days."""
    first = top_per_key(forecast, ["user_id"], [F.asc("forecast_date")], 7)
    return first.groupBy("user_id").agg(
        money(exact_sum(F.col("predicted_revenue")).cast("double")).alias("revenue"),
        F.sum("predicted_orders").alias("orders"),
    ).withColumn("aov", money(ratio(F.col("revenue"), F.col("orders"))))


def confidence_band(forecast: DataFrame) -> DataFrame:
    """Width of the prediction interval per day and the mean predicted revenue of the series."""
    mean = forecast.groupBy("user_id").agg(
        money(F.avg(F.col("predicted_revenue").cast("decimal(18,2)")).cast("double")).alias("mean_revenue")
    )
    return forecast.join(mean, "user_id").select(
        "user_id", "forecast_date", money(F.col("upper_bound") - F.col("lower_bound")).alias("band_width"),
        "mean_revenue",
    )

"""Registered queries: dashboard reads, list views and analyst scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import exact_sum, iso_day, money as m
from tillwater.operators import analyst, dashboard
from tillwater.plans.sql import AS_OF, money, query, r, xsum
from tillwater.sources.testdata import Tables

QUERIES = {}
ORACLES = {}


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def datasets(t: Tables) -> DataFrame:
    """One upload per tenant and year of orders, as the dataset table."""
    year = F.year("order_date")
    return t.orders.groupBy("user_id", year.alias("_y")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max("order_date").alias("uploaded_at")
    ).select(
        "user_id",
        F.concat_ws("-", F.lit("ds"), "user_id", F.col("_y").cast("string")).alias("dataset_id"),
        F.concat(F.lit("Orders "), F.col("_y").cast("string")).alias("name"),
        "row_count",
        F.when(F.col("_y") == 2001, "processing").otherwise("completed").alias("status"),
        "uploaded_at",
    )


DATASETS_SQL = """SELECT user_id, 'ds-' || user_id || '-' || CAST(year(order_date) AS VARCHAR) AS dataset_id,
    'Orders ' || CAST(year(order_date) AS VARCHAR) AS name, COUNT(*) AS row_count,
    CASE WHEN year(order_date) = 2001 THEN 'processing' ELSE 'completed' END AS status,
    MAX(order_date) AS uploaded_at FROM ord GROUP BY user_id, year(order_date)"""

PERF = f"""SELECT i.product_id, d.user_id, i.order_id,
    SUM(CAST(greatest(0.0, i.quantity * i.unit_price - i.discount) AS DECIMAL(18,6))) AS rev, SUM(i.quantity) AS qty
    FROM item i JOIN done d ON i.order_id = d.order_id GROUP BY ALL"""
SOLD = """SELECT user_id, product_id, SUM(qty) AS quantity_sold, CAST(SUM(rev) AS DOUBLE) AS revenue_raw,
    COUNT(*) AS order_count FROM per_order GROUP BY ALL"""
PERF_BODY = f"""SELECT s.user_id, s.product_id, COALESCE(p.name, 'Unknown Product') AS name,
    COALESCE(p.category, 'Uncategorized') AS category, quantity_sold, order_count,
    {money('revenue_raw')} AS revenue, {money('revenue_raw / nullif(quantity_sold, 0)')} AS average_selling_price,
    {money('revenue_raw / nullif(sum_all, 0) * 100')} AS revenue_share
    FROM sold s JOIN (SELECT user_id, CAST(SUM(CAST(revenue_raw AS DECIMAL(28,6))) AS DOUBLE) AS sum_all
      FROM sold GROUP BY user_id) a ON a.user_id = s.user_id
    LEFT JOIN product p ON p.product_id = s.product_id AND p.user_id = s.user_id"""


@register("product_performance", query("done item product", PERF_BODY, per_order=PERF, sold=SOLD))
def product_performance(t):
    return dashboard.product_performance(t.order_items, t.completed, t.products)


@register("product_performance_summary", query("done item product", f"""
    SELECT user_id, COUNT(*) AS total_products, {money(xsum('revenue'))} AS total_revenue,
      arg_max(product_id, ROW(revenue, -product_id)) AS top_product_id,
      arg_max(name, ROW(revenue, -product_id)) AS top_product_name,
      MAX(revenue) AS top_product_revenue FROM perf GROUP BY user_id""", per_order=PERF, sold=SOLD, perf=PERF_BODY))
def product_performance_summary(t):
    return dashboard.product_performance_summary(
        dashboard.product_performance(t.order_items, t.completed, t.products)
    )


MONTHS = f"""SELECT y.user_id, y.year, g.month, {money('rev')} AS revenue, COALESCE(n, 0) AS orders
    FROM (SELECT user_id, MAX(year(order_date)) AS year FROM done GROUP BY user_id) y
    CROSS JOIN (SELECT unnest(range(1, 13)) AS month) g
    LEFT JOIN (SELECT user_id, year(order_date) AS year, month(order_date) AS month,
      {xsum('total_amount')} AS rev, COUNT(*) AS n FROM done GROUP BY ALL) b
    ON b.user_id = y.user_id AND b.year = y.year AND b.month = g.month"""


@register("monthly_revenue", query("done", MONTHS))
def monthly_revenue(t):
    return dashboard.monthly_revenue(t.completed)


@register("monthly_revenue_summary", query("done", f"""
    SELECT user_id, year, {money('total')} AS total_revenue, active_months, {money('total / 12')} AS average_monthly_revenue,
      {money('total / nullif(active_months, 0)')} AS average_active_month_revenue, best.month AS best_month,
      {money('best.revenue')} AS best_month_revenue
    FROM (SELECT user_id, year, {xsum('revenue')} AS total, COUNT(*) FILTER (revenue > 0) AS active_months,
      arg_max({{'month': month, 'revenue': revenue}}, ROW(revenue, -month)) AS best FROM months GROUP BY ALL)""",
    months=MONTHS))
def monthly_revenue_summary(t):
    return dashboard.monthly_summary(dashboard.monthly_revenue(t.completed)).withColumn(
        "best_month", F.col("best_month").cast("long")
    )


@register("available_years", query("done", "SELECT DISTINCT user_id, year(order_date) AS year FROM done"))
def available_years(t):
    return dashboard.available_years(t.completed)


@register("recent_orders", query("ord item cust", f"""
    SELECT o.user_id, o.rank, o.order_id, o.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name, c.country,
      o.status, {money('o.total_amount')} AS total_amount,
      (SELECT COUNT(*) FROM item i WHERE i.order_id = o.order_id) AS item_count,
      strftime(o.order_date, '%Y-%m-%d') AS order_day
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC, order_id DESC) AS rank FROM ord) o
    LEFT JOIN cust c ON c.user_id = o.user_id AND c.customer_id = o.customer_id WHERE o.rank <= 10"""))
def recent_orders(t):
    return dashboard.recent_orders(t.orders, t.order_items, t.customers)


DAILY = f"""SELECT s.user_id, s.day, {money('b.rev')} AS revenue, COALESCE(b.n, 0) AS orders FROM (
      SELECT user_id, unnest(generate_series(MIN(CAST(order_date AS DATE)), MAX(CAST(order_date AS DATE)), INTERVAL 1 DAY)) AS day
      FROM done GROUP BY user_id) s
    LEFT JOIN (SELECT user_id, CAST(order_date AS DATE) AS day, {xsum('total_amount')} AS rev, COUNT(*) AS n
      FROM done GROUP BY ALL) b ON b.user_id = s.user_id AND b.day = s.day"""


@register("daily_revenue", query("done", "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, revenue, orders FROM daily",
                                 daily=DAILY))
def daily_revenue(t):
    return dashboard.daily_revenue(t.completed).withColumn("day", iso_day(F.col("day")))


@register("last_30_days", query("done", f"""
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, revenue, orders FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM daily) WHERE k <= 30""", daily=DAILY))
def last_30_days(t):
    return analyst.last_days(dashboard.daily_revenue(t.completed), 30).withColumn("day", iso_day(F.col("day")))


@register("history_page", query("done", f"""
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, revenue, orders FROM daily
    ORDER BY daily.day DESC, user_id LIMIT 10 OFFSET 10""", daily=DAILY))
def history_page(t):
    rows = analyst.page(dashboard.daily_revenue(t.completed), [F.desc("day"), F.asc("user_id")], 2)
    return rows.withColumn("day", iso_day(F.col("day")))


@register("history_quality", query("ord", f"""
    SELECT user_id, observed_days, calendar_days, calendar_days - observed_days AS missing_days,
      {r('observed_days / calendar_days', 4)} AS coverage,
      CASE WHEN observed_days = 1 THEN 'insufficient' WHEN observed_days / calendar_days >= 0.9 THEN 'high'
        WHEN observed_days / calendar_days >= 0.7 THEN 'medium' ELSE 'low' END AS quality
    FROM (SELECT user_id, COUNT(DISTINCT CAST(order_date AS DATE)) AS observed_days,
      date_diff('day', MIN(CAST(order_date AS DATE)), MAX(CAST(order_date AS DATE))) + 1 AS calendar_days
      FROM ord GROUP BY user_id)"""))
def history_quality(t):
    return dashboard.history_quality(t.orders)


@register("dataset_list", query("ord", """SELECT user_id, dataset_id, name, row_count, status,
    strftime(uploaded_at, '%Y-%m-%d') AS uploaded_day FROM ds""", ds=DATASETS_SQL))
def dataset_list(t):
    return dashboard.dataset_list(datasets(t)).withColumn("uploaded_day", iso_day(F.col("uploaded_at"))).drop("uploaded_at")


@register("latest_dataset", query("ord", """SELECT user_id, arg_max(dataset_id, ROW(uploaded_at, dataset_id)) AS dataset_id
    FROM ds WHERE status = 'completed' GROUP BY user_id""", ds=DATASETS_SQL))
def latest_dataset(t):
    return dashboard.latest_dataset(datasets(t))


@register("safe_money", query("", f"""
    SELECT c_custkey, {money('c_acctbal / nullif(c_nationkey, 0)')} AS per_nation FROM customer"""))
def safe_money(t):
    return t.raw("customer").select(
        "c_custkey", m(F.try_divide("c_acctbal", F.nullif("c_nationkey", F.lit(0)))).alias("per_nation")
    )


@register("provenance_split", query("done", f"""
    SELECT *, {money('synthetic_orders / orders * 100')} AS synthetic_share FROM (
      SELECT user_id, COUNT(*) AS orders, COUNT(*) FILTER (syn) AS synthetic_orders,
        {money('SUM(CAST(CASE WHEN syn THEN total_amount END AS DECIMAL(18,6)))')} AS synthetic_revenue,
        {money('SUM(CAST(CASE WHEN NOT syn THEN total_amount END AS DECIMAL(18,6)))')} AS real_revenue
      FROM (SELECT *, regexp_matches(CAST(order_id AS VARCHAR), '^1[0-9]*5$') AS syn FROM done) GROUP BY user_id)"""))
def provenance_split(t):
    return analyst.provenance_split(t.completed, "^1[0-9]*5$")


@register("orders_with_prefix", query("ord", f"""
    SELECT user_id, order_id, status, {money('total_amount')} AS total_amount, strftime(order_date, '%Y-%m-%d') AS order_day
    FROM ord WHERE starts_with(CAST(order_id AS VARCHAR), '12') OR starts_with(CAST(order_id AS VARCHAR), '77')"""))
def orders_with_prefix(t):
    return analyst.orders_with_prefix(t.orders, ["12", "77"])


@register("order_drilldown", query("ord item cust", f"""
    SELECT o.user_id, o.order_id, strftime(o.order_date, '%Y-%m-%d') AS order_day, o.status, o.customer_id,
      c.name AS customer_name, i.product_id, i.quantity, {money('i.total_price')} AS total_price
    FROM ord o LEFT JOIN item i ON i.order_id = o.order_id
    LEFT JOIN cust c ON c.customer_id = o.customer_id AND c.user_id = o.user_id
    WHERE o.order_date >= TIMESTAMP '2001-07-01' AND o.order_date < TIMESTAMP '2001-08-01'"""))
def order_drilldown(t):
    return analyst.order_drilldown(t.orders, t.order_items, t.customers, "2001-07-01", "2001-08-01")


@register("order_days", query("ord", f"""
    SELECT user_id, strftime(order_date, '%Y-%m-%d') AS day, COUNT(*) AS orders, {money(xsum('total_amount'))} AS revenue
    FROM ord GROUP BY ALL"""))
def order_days(t):
    return analyst.order_days(t.orders)


@register("table_counts", query("ord product cust", """
    SELECT user_id, COUNT(*) AS rows, 'orders' AS "table" FROM ord GROUP BY user_id
    UNION ALL SELECT user_id, COUNT(*), 'products' FROM product GROUP BY user_id
    UNION ALL SELECT user_id, COUNT(*), 'customers' FROM cust GROUP BY user_id"""))
def table_counts(t):
    return analyst.table_counts({"orders": t.orders, "products": t.products, "customers": t.customers})


@register("status_counts", query("ord", "SELECT user_id, status, COUNT(*) AS orders FROM ord GROUP BY ALL"))
def status_counts(t):
    return analyst.status_counts(t.orders)


@register("nested_orders", query("ord item product", f"""
    SELECT o.user_id, o.order_id, strftime(o.order_date, '%Y-%m-%d') AS order_day, COALESCE(n.lines, '') AS lines
    FROM ord o LEFT JOIN (
      SELECT x.order_id, string_agg(CAST(i.product_id AS VARCHAR) || ':' || p.name || ':' ||
        CAST(CAST(i.quantity AS BIGINT) AS VARCHAR), ';' ORDER BY i.product_id, p.name, i.quantity) AS lines
      FROM item i JOIN ord x ON x.order_id = i.order_id
      LEFT JOIN product p ON p.product_id = i.product_id AND p.user_id = x.user_id GROUP BY x.order_id) n
    ON n.order_id = o.order_id"""))
def nested_orders(t):
    rows = analyst.nested_orders(t.orders, t.order_items, t.products)
    line = lambda e: F.concat_ws(
        ":", e["product_id"].cast("string"), e["name"], e["quantity"].cast("bigint").cast("string")
    )
    return rows.withColumn("lines", F.coalesce(F.array_join(F.transform("items", line), ";"), F.lit(""))).drop("items")


@register("product_listing", query("product", "SELECT user_id, product_id, name, category, price FROM product"))
def product_listing(t):
    return analyst.product_listing(t.products)


@register("customers_by_country", query("cust done", f"""
    SELECT c.user_id, c.country, COUNT(DISTINCT c.customer_id) AS customers, COUNT(d.order_id) AS orders,
      {money(xsum('d.total_amount'))} AS revenue
    FROM cust c LEFT JOIN done d ON d.customer_id = c.customer_id AND d.user_id = c.user_id GROUP BY ALL"""))
def customers_by_country(t):
    spent = t.completed.groupBy("user_id", "customer_id").agg(
        F.count(F.lit(1)).alias("orders"), exact_sum(F.col("total_amount")).alias("spent")
    )
    return t.customers.join(spent, ["user_id", "customer_id"], "left").groupBy("user_id", "country").agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        m(F.sum("spent").cast("double")).alias("revenue"),
    )

"""Tenants' totals and the size of adaptive partitions don't let a task's memory grow with the tables."""

from tillwater.operators import dashboard, recommend
from tillwater.sources.testdata import Tables


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_totals_of_tenants_do_not_gather_their_products(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        history = spark.createDataFrame([("u", "c", "p")], "user_id string, customer_id string, product_id string")
        pop = recommend.popularity(history)
        assert "SortMergeJoin" not in plan(pop)
        assert [tuple(r) for r in pop.collect()] == [("u", "p", 1, 1.0)]
        orders = spark.createDataFrame([("u", 1, "completed")], "user_id string, order_id long, status string")
        items = spark.createDataFrame(
            [(1, "p", 2.0, 3.0, 0.0)], "order_id long, product_id string, quantity double, unit_price double, discount double"
        )
        products = spark.createDataFrame([("u", "p", "Name", "A")], "user_id string, product_id string, name string, category string")
        sold = dashboard.product_performance(items, orders, products)
        assert plan(sold).count("SortMergeJoin") == 1  # the catalogue
        assert [(r["revenue"], r["revenue_share"]) for r in sold.collect()] == [(6.0, 100.0)]
    finally:
        spark.conf.unset(key)


def test_adaptive_partitions_are_small_unless_the_session_says_so(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    had = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        Tables(spark, "nowhere")
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "9m")
        Tables(spark, "nowhere")
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)

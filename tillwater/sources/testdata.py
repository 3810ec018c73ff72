"""Adapter from the star-schema parquet tables to the canonical commerce model.

The tenant (``user_id``) of a customer is its market segment; orders take the
tenant of their customer; the part catalogue is offered by every tenant.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwater.session import bound_tasks, use_utc

# Order status codes of the source tables.
STATUS = {"F": "completed", "O": "processing", "P": "shipped"}


class Tables:
    """Lazy canonical frames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        use_utc(spark)
        bound_tasks(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("country"))
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_mktsegment").alias("user_id"),
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("name"),
                "country",
            )
        )

    @cached_property
    def tenant_of(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_mktsegment").alias("user_id"), F.col("c_custkey").alias("customer_id")
        )

    @cached_property
    def tenants(self) -> list[str]:
        """Names of all tenants that have a customer."""
        found = self.tenant_of.filter("user_id is not null").select("user_id").distinct().collect()
        return sorted(r["user_id"] for r in found)

    @cached_property
    def orders(self) -> DataFrame:
        status = F.coalesce(
            *[F.when(F.col("o_orderstatus") == code, F.lit(name)) for code, name in STATUS.items()]
        )
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
            status.alias("status"),
            F.col("o_totalprice").alias("total_amount"),
        )
        return orders.join(self.tenant_of, "customer_id")

    @cached_property
    def completed(self) -> DataFrame:
        """Completed orders with the status test on the raw code, so that it reaches the scan."""
        orders = self.raw("orders").filter(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("order_date"),
            F.lit("completed").alias("status"),
            F.col("o_totalprice").alias("total_amount"),
        )
        return orders.join(self.tenant_of, "customer_id")

    @cached_property
    def order_items(self) -> DataFrame:
        gross = F.col("l_extendedprice")
        money_off = gross * F.col("l_discount")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            (gross / F.col("l_quantity")).alias("unit_price"),
            money_off.alias("discount"),
            F.greatest(F.lit(0.0), gross - money_off).alias("total_price"),
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def products(self) -> DataFrame:
        tenants = F.array(*[F.lit(t) for t in self.tenants])
        return self.catalogue.withColumn("user_id", F.explode(tenants))

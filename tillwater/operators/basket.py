"""Market-basket analysis per tenant: transactions, itemsets, rules, summary."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import order_key, rounded
from tillwater.session import stored

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.30
# Run metadata.
ALGORITHM, MODEL_VERSION = "Apriori", "apriori-market-basket-v1"
# Separates the tenant from the product in the items handed to FP-growth.
SEP = "\u0001"


def transactions(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per completed order with its distinct, trimmed, non-blank product ids.

    Tenants with fewer than two distinct products have nothing to mine. Lines
    are made distinct before baskets are built, so repeated lines are combined early.
    """
    product = F.nullif(F.trim(F.col("product_id").cast("string")), F.lit(""))
    lines = (
        items.join(orders.filter("status = 'completed'").select("user_id", "order_id"), order_key(items))
        .select("user_id", "order_id", product.alias("product_id"))
        .filter("product_id is not null")
        .distinct()
    )
    enough = (
        lines.select("user_id", "product_id").distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    )
    return (
        lines.join(enough, "user_id", "left_semi")
        .groupBy("user_id", "order_id")
        .agg(F.array_sort(F.collect_list("product_id")).alias("items"))
    )


def basket_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id").agg(F.count(F.lit(1)).alias("transactions"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def frequent_itemsets(tx: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = 1) -> DataFrame:
    """Itemsets of any length with support >= ``min_support`` within their tenant, in at least ``min_count`` baskets.

    All tenants of similar basket count (same power of two) are mined in one
    FP-growth run on tenant-tagged items: an itemset never mixes tenants, so a
    run at the lowest threshold of its class finds every frequent set, and the
    exact threshold of each tenant is applied afterwards. The number of runs
    depends on the spread of tenant sizes (at most one per power of two), not
    on the number of tenants.
    """
    counts = basket_counts(tx)
    classes = [r["c"] for r in counts.select(_size_class(F.col("transactions")).alias("c")).distinct().collect()]
    tagged = tx.join(counts, "user_id").select(
        _size_class(F.col("transactions")).alias("_class"),
        F.transform("items", lambda i: F.concat("user_id", F.lit(SEP), i)).alias("items"),
    ).persist()
    found = None
    for c in sorted(classes):
        baskets = tagged.filter(F.col("_class") == c).select("items")
        total = baskets.count()
        # FP-growth keeps sets with at least ceil(support * total) baskets: stay a little below.
        floor_count = max(1.0, min_count, min_support * 2**c)
        sets = FPGrowth(minSupport=min(1.0, max(0.0, (floor_count - 0.5) / total)), minConfidence=1.0).fit(baskets)
        part = sets.freqItemsets
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = "user_id string, items array<string>, size int, item_count bigint, transactions bigint, support double"
        return tx.sparkSession.createDataFrame([], empty)
    # The sets are few next to the baskets: store them once instead of mining again for every later use.
    found = stored(found)
    tagged.unpersist()
    tenant = F.substring_index(F.col("items")[0], SEP, 1)
    plain = F.array_sort(F.transform("items", lambda i: F.substring_index(i, SEP, -1)))
    share = F.col("item_count") / F.col("transactions")
    return (
        found.select(tenant.alias("user_id"), plain.alias("items"), F.col("freq").alias("item_count"))
        .join(counts, "user_id")
        .filter((share >= min_support) & (F.col("item_count") >= min_count))
        .select("user_id", "items", F.size("items").alias("size"), "item_count", "transactions", share.alias("support"))
    )


def itemset_listing(itemsets: DataFrame) -> DataFrame:
    return itemsets.select(
        "user_id", "items", "size", "item_count", rounded(F.col("support"), 4).alias("support")
    ).orderBy("user_id", "size", F.desc("support"), "items")


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Every split of every itemset into two non-empty parts.

    The splits of an itemset are the masks 1 .. 2^k - 2; both parts of a
    frequent set are frequent themselves, so their supports come from two joins.
    """
    split = (
        itemsets.filter("size >= 2")
        .withColumn("_m", F.explode(F.expr("sequence(1L, shiftleft(1L, size) - 2L)")))
        .withColumn("antecedent", F.expr("filter(items, (x, i) -> shiftright(_m, i) % 2 = 1)"))
        .withColumn("consequent", F.expr("filter(items, (x, i) -> shiftright(_m, i) % 2 = 0)"))
        .select("user_id", "antecedent", "consequent", "support")
    )
    part = lambda name: itemsets.select(
        "user_id", F.col("items").alias(name), F.col("support").alias(f"_{name}")
    )
    confidence = F.col("support") / F.col("_antecedent")
    return (
        split.join(part("antecedent"), ["user_id", "antecedent"])
        .filter(confidence >= min_confidence)
        .join(part("consequent"), ["user_id", "consequent"])
        .select(
            "user_id",
            "antecedent",
            "consequent",
            rounded(F.col("support"), 4).alias("support"),
            rounded(confidence, 4).alias("confidence"),
            rounded(confidence / F.col("_consequent"), 4).alias("lift"),
        )
    )


def rule_order() -> list[Column]:
    """Lift, confidence, support descending on the rounded values, then the items."""
    return [F.desc("lift"), F.desc("confidence"), F.desc("support"), F.asc("antecedent"), F.asc("consequent")]


def ordered_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("user_id", *rule_order())


def summary(tx: DataFrame, itemsets: DataFrame, rules: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Counts, mean confidence, largest lift and the strongest rule; zeros where nothing was found.

    ``tenants`` (``user_id``) adds a row of zeros for tenants without baskets.
    """
    baskets = basket_counts(tx)
    if tenants is not None:
        baskets = tenants.select("user_id").distinct().join(baskets, "user_id", "left").na.fill(0, ["transactions"])
    products = (
        tx.select("user_id", F.explode("items").alias("_p")).distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("products"))
    )
    sets = itemsets.groupBy("user_id").agg(F.count(F.lit(1)).alias("itemsets"))
    # Strength runs opposite to the item tie-break, hence min_by on the negated measures.
    strength = F.struct(-F.col("lift"), -F.col("confidence"), -F.col("support"), "antecedent", "consequent")
    found = rules.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rules"),
        rounded(F.avg(F.col("confidence").cast("decimal(18,4)")).cast("double"), 4).alias("average_confidence"),
        F.max("lift").alias("max_lift"),
        F.min_by(F.struct("antecedent", "consequent"), strength).alias("_top"),
    )
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return (
        baskets.join(products, "user_id", "left").join(sets, "user_id", "left").join(found, "user_id", "left")
        .select(
            "user_id", "transactions", zero("products", 0), zero("itemsets", 0), zero("rules", 0),
            zero("average_confidence", 0.0), zero("max_lift", 0.0),
            F.col("_top.antecedent").alias("top_antecedent"), F.col("_top.consequent").alias("top_consequent"),
        )
    )


def resolve_products(rules: DataFrame, products: DataFrame, column: str) -> DataFrame:
    """Replace the ids of ``column`` by (id, name, category, price) structs in the same order."""
    keyed = rules.withColumn("_rule", F.struct(*rules.columns))
    ids = keyed.select("_rule", "user_id", F.posexplode(column).alias("_pos", "product_id"))
    catalogue = products.select(
        "user_id", F.col("product_id").cast("string").alias("product_id"), "name", "category", "price"
    )
    detail = (
        ids.join(catalogue, ["user_id", "product_id"], "left")
        .groupBy("_rule")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_pos",
                        F.struct(
                            "product_id",
                            F.coalesce("name", F.lit("Unknown Product")).alias("name"),
                            "category",
                            "price",
                        ).alias("product"),
                    )
                )
            ).alias("_d")
        )
    )
    named = F.transform("_d", lambda d: d["product"]).alias(f"{column}_products")
    return detail.select("_rule.*", named)

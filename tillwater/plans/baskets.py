"""Registered queries: baskets, rules and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions.scalars import rounded
from tillwater.operators import analyst, basket, closed, dashboard, recommend
from tillwater.plans.relational import register
from tillwater.plans.sql import query, r
from tillwater.sources.testdata import Tables


def type_transactions(t: Tables) -> DataFrame:
    """Baskets of part types (six): large supports, long itemsets."""
    lines = t.order_items.join(t.catalogue.select("product_id", "category"), "product_id").select(
        "order_id", F.col("category").alias("product_id")
    )
    return basket.transactions(lines, t.completed)


def brand_items(t: Tables) -> DataFrame:
    return t.order_items.join(t.catalogue.select("product_id", "brand"), "product_id").select(
        "order_id", F.col("brand").alias("product_id")
    )


def brand_products(t: Tables) -> DataFrame:
    """Brands as products; the category is the commonest part type of the brand."""
    counts = t.catalogue.groupBy("brand", "category").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("price"))
    best = counts.groupBy("brand").agg(
        F.max_by("category", F.struct("n", "category")).alias("category"), F.max("price").alias("price")
    )
    return best.select(
        F.explode(F.array(*[F.lit(x) for x in t.tenants])).alias("user_id"),
        F.col("brand").alias("product_id"),
        F.concat(F.lit("All of "), "brand").alias("name"),
        "category",
        "price",
    )


def brand_rules(t: Tables) -> DataFrame:
    tx = basket.transactions(brand_items(t), t.completed)
    return basket.association_rules(basket.frequent_itemsets(tx, 0.01), 0.15)


#: A set of products counts from this share of a tenant's baskets on, and from two baskets on.
PRODUCT_SUPPORT, PRODUCT_BASKETS = 0.0002, 2


def product_rules(t: Tables) -> DataFrame:
    """Rules between actual products that imply all others (generator to closed set)."""
    tx = basket.transactions(t.order_items, t.completed)
    return closed.rules(closed.generators(tx, PRODUCT_SUPPORT, PRODUCT_BASKETS))


# ---- itemsets and rules of up to six items as bit masks ----
TX = """SELECT DISTINCT d.user_id, d.order_id, trim({item}) AS p FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN done d ON d.order_id = l_orderkey"""
NUMBERED = "SELECT *, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) AS k FROM tx"
MASKS = "SELECT user_id, order_id, bit_or(1::BIGINT << k) AS m FROM numbered GROUP BY ALL"
SETS = """SELECT b.user_id, s.m, COUNT(*) AS c, any_value(n.n) AS n FROM masks b
    JOIN (SELECT unnest(range(1, (1::BIGINT << (SELECT COUNT(DISTINCT k) FROM numbered)))) AS m) s ON b.m & s.m = s.m
    JOIN (SELECT user_id, COUNT(*) AS n FROM masks GROUP BY user_id) n ON n.user_id = b.user_id
    GROUP BY b.user_id, s.m HAVING COUNT(*) / any_value(n.n) >= 0.01"""
NAMES = """SELECT s.m, string_agg(x.p, '|' ORDER BY x.p) AS items, COUNT(*) AS size FROM (SELECT DISTINCT m FROM sets) s
    JOIN (SELECT DISTINCT k, p FROM numbered) x ON (s.m >> x.k) & 1 = 1 GROUP BY s.m"""
TYPE_SETS = {"tx": TX.format(item="p_type"), "numbered": NUMBERED, "masks": MASKS, "sets": SETS, "names": NAMES}
RULES = f"""SELECT s.user_id, a.m AS am, c.m AS cm, {r('s.c / s.n', 4)} AS support, {r('(s.c / s.n) / (a.c / a.n)', 4)} AS confidence,
    {r('(s.c / s.n) / (a.c / a.n) / (c.c / c.n)', 4)} AS lift
    FROM sets s JOIN sets a ON a.user_id = s.user_id AND a.m & s.m = a.m AND a.m <> s.m
    JOIN sets c ON c.user_id = s.user_id AND c.m = s.m - a.m
    WHERE (s.c / s.n) / (a.c / a.n) >= 0.30"""
NAMED_RULES = """SELECT r.user_id, a.items AS antecedent, c.items AS consequent, support, confidence, lift
    FROM rules r JOIN names a ON a.m = r.am JOIN names c ON c.m = r.cm"""
TYPE_RULES = {**TYPE_SETS, "rules": RULES, "named": NAMED_RULES}


def joined(c: str):
    return F.array_join(c, "|").alias(c)


@register("transactions", query("done", """SELECT user_id, order_id, string_agg(p, '|' ORDER BY p) AS items FROM tx
    GROUP BY ALL""", tx=TX.format(item="p_brand")))
def transactions(t):
    return basket.transactions(brand_items(t), t.completed).select("user_id", "order_id", joined("items"))


@register("frequent_itemsets", query("done", f"""SELECT s.user_id, n.items, n.size, s.c AS item_count,
    {r('s.c / s.n', 4)} AS support FROM sets s JOIN names n ON n.m = s.m""", **TYPE_SETS))
def frequent_itemsets(t):
    sets = basket.itemset_listing(basket.frequent_itemsets(type_transactions(t)))
    return sets.withColumn("items", joined("items")).withColumn("size", F.col("size").cast("long"))


@register("association_rules", query("done", "SELECT * FROM named", **TYPE_RULES))
def association_rules(t):
    rules = basket.ordered_rules(basket.association_rules(basket.frequent_itemsets(type_transactions(t))))
    return rules.withColumn("antecedent", joined("antecedent")).withColumn("consequent", joined("consequent"))


@register("basket_summary", query("done", f"""
    SELECT b.user_id, b.transactions, p.products, s.itemsets, q.rules, q.average_confidence, q.max_lift, x.antecedent AS top_antecedent,
      x.consequent AS top_consequent
    FROM (SELECT user_id, COUNT(*) AS transactions FROM masks GROUP BY user_id) b
    JOIN (SELECT user_id, COUNT(DISTINCT p) AS products FROM tx GROUP BY user_id) p ON p.user_id = b.user_id
    JOIN (SELECT user_id, COUNT(*) AS itemsets FROM sets GROUP BY user_id) s ON s.user_id = b.user_id
    JOIN (SELECT user_id, COUNT(*) AS rules, {r('AVG(confidence)', 4)} AS average_confidence, MAX(lift) AS max_lift FROM rules
      GROUP BY user_id) q ON q.user_id = b.user_id
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lift DESC, confidence DESC, support DESC,
      string_split(antecedent, '|'), string_split(consequent, '|')) AS k FROM named) x ON x.user_id = b.user_id AND x.k = 1""", **TYPE_RULES))
def basket_summary(t):
    tx = type_transactions(t)
    sets = basket.frequent_itemsets(tx)
    out = basket.summary(tx, sets, basket.association_rules(sets), t.tenant_of)
    return out.withColumn("top_antecedent", joined("top_antecedent")).withColumn("top_consequent", joined("top_consequent"))


# Brand rules (the recommendation queries use them): itemsets of up to four brands as sorted lists.
def brand_sets(k: int) -> str:
    names = "abcd"[:k]
    joins = "".join(
        f" JOIN tx {x} ON {x}.user_id = a.user_id AND {x}.order_id = a.order_id AND {x}.p > {names[i]}.p"
        for i, x in enumerate(names[1:])
    )
    items = ", ".join(f"{x}.p" for x in names)
    return f"""SELECT a.user_id, [{items}] AS items, COUNT(*) AS c FROM tx a{joins} GROUP BY ALL"""


BRAND_TX = TX.format(item="p_brand")
BRAND_SETS = f"""SELECT s.user_id, s.items, s.c, n.n FROM ({" UNION ALL ".join(brand_sets(k) for k in (1, 2, 3, 4))}) s
    JOIN (SELECT user_id, COUNT(DISTINCT order_id) AS n FROM tx GROUP BY user_id) n ON n.user_id = s.user_id
    WHERE s.c / n.n >= 0.01"""
BRAND_RULES = f"""SELECT s.user_id, a.items AS antecedent, c.items AS consequent, {r('s.c / s.n', 4)} AS support,
    {r('(s.c / s.n) / (a.c / a.n)', 4)} AS confidence, {r('(s.c / s.n) / (a.c / a.n) / (c.c / c.n)', 4)} AS lift
    FROM sets s JOIN sets a ON a.user_id = s.user_id AND len(a.items) < len(s.items) AND list_has_all(s.items, a.items)
    JOIN sets c ON c.user_id = s.user_id AND c.items = list_filter(s.items, lambda x: NOT list_contains(a.items, x))
    WHERE (s.c / s.n) / (a.c / a.n) >= 0.15"""
BRANDS = {
    "tx": BRAND_TX, "sets": BRAND_SETS, "rules": BRAND_RULES,
    "brand": """SELECT user_id, p_brand AS product_id, 'All of ' || p_brand AS name, category, price FROM (
      SELECT p_brand, arg_max(p_type, ROW(n, p_type)) AS category, MAX(price) AS price FROM (
        SELECT p_brand, p_type, COUNT(*) AS n, MAX(p_retailprice) AS price FROM part GROUP BY ALL) GROUP BY p_brand)
      CROSS JOIN (SELECT DISTINCT user_id FROM tenant)""",
    "history": """SELECT DISTINCT d.user_id, d.customer_id, p_brand AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN done d ON d.order_id = l_orderkey""",
}
PARTS = {
    "brand": "SELECT user_id, product_id, name, category, price FROM product",
    "history": "SELECT DISTINCT d.user_id, d.customer_id, i.product_id FROM item i JOIN done d ON d.order_id = i.order_id",
}


def named_list(column: str) -> str:
    return f"""(SELECT string_agg(b.name || ' (' || b.category || ')', '|' ORDER BY b.product_id) FROM brand b
      WHERE b.user_id = u.user_id AND list_contains(u.{column}, b.product_id))"""


@register("basket_rules_resolved", query("done", f"""
    SELECT u.user_id, array_to_string(u.antecedent, '|') AS antecedent, array_to_string(u.consequent, '|') AS consequent, u.lift,
      {named_list('antecedent')} AS antecedent_names, {named_list('consequent')} AS consequent_names FROM rules u""", **BRANDS))
def basket_rules_resolved(t):
    products = brand_products(t)
    rules = basket.resolve_products(brand_rules(t), products, "antecedent")
    rules = basket.resolve_products(rules, products, "consequent")
    named = lambda c: F.array_join(
        F.transform(f"{c}_products", lambda p: F.concat(p["name"], F.lit(" ("), p["category"], F.lit(")"))), "|"
    ).alias(f"{c}_names")
    return rules.select(
        "user_id", joined("antecedent"), joined("consequent"), "lift", named("antecedent"), named("consequent")
    )


SIGNALS = {
    "pop": """SELECT user_id, product_id, COUNT(*) AS buyers, COUNT(*) / MAX(COUNT(*)) OVER (PARTITION BY user_id) AS popularity
      FROM history GROUP BY user_id, product_id""",
    "share": f"""SELECT user_id, category, {r('SUM(buyers) / SUM(SUM(buyers)) OVER (PARTITION BY user_id)', 4)} AS share
      FROM pop JOIN brand USING (user_id, product_id) GROUP BY user_id, category""",
    "cataff": f"""SELECT user_id, customer_id, category,
      {r('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id, customer_id)', 4)} AS affinity
      FROM history JOIN brand USING (user_id, product_id) GROUP BY user_id, customer_id, category""",
    "co": """SELECT a.user_id, a.product_id AS bought, b.product_id, COUNT(*) AS n FROM history a JOIN history b
      ON a.user_id = b.user_id AND a.customer_id = b.customer_id AND a.product_id <> b.product_id GROUP BY ALL""",
    "prodraw": """SELECT h.user_id, h.customer_id, c.product_id, SUM(c.n) AS s FROM history h
      JOIN co c ON c.user_id = h.user_id AND c.bought = h.product_id
      WHERE NOT EXISTS (SELECT 1 FROM history x WHERE x.user_id = h.user_id AND x.customer_id = h.customer_id
        AND x.product_id = c.product_id) GROUP BY ALL""",
    "prodaff": f"""SELECT user_id, customer_id, product_id, {r('s / MAX(s) OVER (PARTITION BY user_id, customer_id)', 4)} AS product_affinity
      FROM prodraw""",
}
BASKET_SCORE = "0.7 * least(1.0, greatest(0.0, u.confidence)) + 0.3 * (CASE WHEN u.lift > 0 THEN u.lift / (1 + u.lift) ELSE 0 END)"
BASKET_SIGNAL = f"""SELECT user_id, customer_id, product_id, basket, CASE WHEN len(names) <= 2 THEN array_to_string(names, ' and ')
      ELSE array_to_string(names[1:3], ', ') END AS ante, names FROM (
    SELECT *, list_transform(antecedent, lambda x: 'All of ' || x) AS names FROM (
      SELECT h.user_id, h.customer_id, u.antecedent, unnest(list_filter(u.consequent, lambda x: NOT list_contains(h.items, x))) AS product_id,
        {BASKET_SCORE} AS basket, u.lift, u.confidence, u.support, u.consequent
      FROM (SELECT user_id, customer_id, list(product_id) AS items FROM history GROUP BY ALL) h
      JOIN rules u ON u.user_id = h.user_id AND list_has_all(h.items, u.antecedent))
    QUALIFY row_number() OVER (PARTITION BY user_id, customer_id, product_id
      ORDER BY basket DESC, lift DESC, confidence DESC, support DESC, antecedent, consequent) = 1)"""
NO_SIGNAL = "SELECT user_id, customer_id, product_id, '' AS ante, 0.0 AS basket FROM history WHERE false"


def scored_sql(w: recommend.Weights) -> str:
    """All (customer, product) candidates, the brute-force form."""
    share = "COALESCE(s.share / st.top, 0.0)" if w.scale_global else "COALESCE(s.share, 0.0)"
    affinity = "COALESCE(pa.product_affinity, 0.0)" if w.use_product_affinity else "0.0"
    personal = f"COALESCE(hn.n, 0) >= {w.min_history}"
    own = f"({w.product_affinity} * {affinity} + {w.category_affinity} * COALESCE(ca.affinity, 0.0))"
    return f"""SELECT *, CASE WHEN personal THEN {w.basket} * basket0 + {w.preference} * preference + {w.popularity} * popularity
        ELSE {w.cold_popularity} * popularity + {w.cold_category} * share END AS final FROM (
      SELECT c.user_id, c.customer_id, b.product_id, b.category, COALESCE(p.popularity, 0.0) AS popularity,
        g.basket, COALESCE(g.basket, 0.0) AS basket0, g.ante, {share} AS share, {personal} AS personal,
        CASE WHEN {personal} THEN {own} ELSE {share} END AS preference
      FROM tenant c JOIN brand b ON b.user_id = c.user_id
      LEFT JOIN pop p ON p.user_id = b.user_id AND p.product_id = b.product_id
      LEFT JOIN share s ON s.user_id = b.user_id AND s.category = b.category
      LEFT JOIN (SELECT user_id, MAX(share) AS top FROM share GROUP BY user_id) st ON st.user_id = b.user_id
      LEFT JOIN cataff ca ON ca.user_id = c.user_id AND ca.customer_id = c.customer_id AND ca.category = b.category
      LEFT JOIN prodaff pa ON pa.user_id = c.user_id AND pa.customer_id = c.customer_id AND pa.product_id = b.product_id
      LEFT JOIN signal g ON g.user_id = c.user_id AND g.customer_id = c.customer_id AND g.product_id = b.product_id
      LEFT JOIN (SELECT user_id, customer_id, COUNT(*) AS n FROM history GROUP BY ALL) hn
        ON hn.user_id = c.user_id AND hn.customer_id = c.customer_id
      LEFT JOIN history h ON h.user_id = c.user_id AND h.customer_id = c.customer_id AND h.product_id = b.product_id
      WHERE h.product_id IS NULL)"""


def recs_sql(w: recommend.Weights) -> str:
    order = "final DESC, basket0 DESC, preference DESC, popularity DESC, product_id DESC"
    first = "k, " if w.two_pass else ""
    return f"""SELECT user_id, customer_id, product_id, {r('final', 4)} AS score,
      CASE WHEN basket IS NOT NULL THEN 'Frequently purchased with ' || ante
        WHEN preference >= 0.50 THEN 'Matches your interest in ' || category
        WHEN preference >= 0.25 THEN 'Based on your ' || category || ' preferences'
        WHEN popularity >= 0.50 THEN 'Popular in the ' || category || ' category'
        WHEN popularity > 0 THEN 'Popular among customers'
        ELSE 'Recommended based on available customer purchase patterns' END AS reason, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, customer_id ORDER BY {first}{order}) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, customer_id, category ORDER BY {order}) AS k FROM scored)
      WHERE k <= {w.per_category}) WHERE rank <= {w.top_n}"""


def rec_ctes(base: dict, signal: str, w: recommend.Weights) -> dict:
    return {**base, **SIGNALS, "signal": signal, "scored": scored_sql(w), "recs": recs_sql(w)}


BRAND_RECS = rec_ctes(BRANDS, BASKET_SIGNAL, recommend.V23)


def brand_history(t: Tables) -> DataFrame:
    return recommend.purchases(t.completed, brand_items(t))


def brand_recs(t: Tables, w: recommend.Weights = recommend.V23) -> DataFrame:
    return recommend.recommend(t.tenant_of, brand_products(t), brand_history(t), brand_rules(t), w)


@register("recommendations", query("done", "SELECT * FROM recs", **BRAND_RECS))
def recommendations(t):
    return brand_recs(t)


@register("recommendations_older", query("done", "SELECT * FROM recs", **rec_ctes(BRANDS, BASKET_SIGNAL, recommend.V21)))
def recommendations_older(t):
    return brand_recs(t, recommend.V21)


@register("recommendations_parts", query("done item product", "SELECT * FROM recs", **rec_ctes(PARTS, NO_SIGNAL, recommend.V23)))
def recommendations_parts(t):
    no_rules = t.spark.createDataFrame(
        [], "user_id string, antecedent array<string>, consequent array<string>, support double, confidence double, lift double"
    ).limit(0)
    return recommend.recommend(t.tenant_of, t.products, recommend.purchases(t.completed, t.order_items), no_rules)


# Sets of any of thousands of products can't be listed in SQL: tests/test_product_rules.py compares with plain counting.
@register("product_transactions", query("done", "SELECT user_id, order_id, string_agg(p, '|' ORDER BY p) AS items FROM tx GROUP BY ALL",
                                        tx=TX.format(item="CAST(p_partkey AS VARCHAR)")))
def product_transactions(t):
    return basket.transactions(t.order_items, t.completed).select("user_id", "order_id", joined("items"))


@register("product_association_rules")
def product_association_rules(t):
    rules = basket.ordered_rules(product_rules(t))
    return rules.withColumn("antecedent", joined("antecedent")).withColumn("consequent", joined("consequent"))


@register("recommendations_products")
def recommendations_products(t):
    return recommend.recommend(t.tenant_of, t.products, recommend.purchases(t.completed, t.order_items), product_rules(t))


@register("purchase_history", query("done item", PARTS["history"]))
def purchase_history(t):
    return recommend.purchases(t.completed, t.order_items)


@register("product_popularity", query("done item", f"SELECT user_id, product_id, buyers, {r('popularity', 4)} AS popularity FROM pop",
                                      history=PARTS["history"], pop=SIGNALS["pop"]))
def product_popularity(t):
    pop = recommend.popularity(recommend.purchases(t.completed, t.order_items))
    return pop.withColumn("popularity", rounded(F.col("popularity"), 4))


@register("global_category_share", query("done item product", "SELECT user_id, category, share FROM share", **{
    **PARTS, "pop": SIGNALS["pop"], "share": SIGNALS["share"]}))
def global_category_share(t):
    pop = recommend.popularity(recommend.purchases(t.completed, t.order_items))
    return recommend.global_category_share(pop, t.products)


@register("category_affinity", query("done item product", "SELECT * FROM cataff", **{**PARTS, "cataff": SIGNALS["cataff"]}))
def category_affinity(t):
    return recommend.category_affinity(recommend.purchases(t.completed, t.order_items), t.products)


@register("product_affinity", query("done item", "SELECT * FROM prodaff", **{
    "history": PARTS["history"], **{k: SIGNALS[k] for k in ("co", "prodraw", "prodaff")}}))
def product_affinity(t):
    return recommend.product_affinity(recommend.purchases(t.completed, t.order_items))


@register("basket_signals", query("done", f"""SELECT user_id, customer_id, product_id, {r('basket', 6)} AS basket,
    array_to_string(names, '|') AS antecedent_names FROM signal""", **{**BRANDS, "signal": BASKET_SIGNAL}))
def basket_signals(t):
    s = recommend.basket_signals(brand_history(t), brand_rules(t), brand_products(t))
    return s.withColumn("basket", rounded(F.col("basket"), 6)).withColumn("antecedent_names", joined("antecedent_names"))


@register("recommendation_list", query("done cust", """
    SELECT q.user_id, q.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name, q.product_id, b.name AS product_name,
      b.category, q.score, q.reason
    FROM recs q LEFT JOIN cust c ON c.customer_id = q.customer_id JOIN brand b ON b.user_id = q.user_id
      AND b.product_id = q.product_id""", **BRAND_RECS))
def recommendation_list(t):
    return dashboard.recommendation_list(brand_recs(t), t.customers, brand_products(t))


@register("recommendation_summary", query("done", f"""SELECT user_id, COUNT(*) AS recommendations,
    COUNT(DISTINCT customer_id) AS customers, {r('AVG(score)', 4)} AS average_score, MAX(score) AS max_score
    FROM recs GROUP BY user_id""", **BRAND_RECS))
def recommendation_summary(t):
    return dashboard.recommendation_summary(brand_recs(t))


@register("customers_with_recommendations", query("done cust", """
    SELECT q.user_id, q.customer_id, c.name, COUNT(*) AS recommendations FROM recs q JOIN cust c
    ON c.customer_id = q.customer_id AND c.user_id = q.user_id WHERE contains(lower(c.name), '#00000012') GROUP BY ALL""",
    **BRAND_RECS))
def customers_with_recommendations(t):
    return analyst.customers_with_recommendations(brand_recs(t), t.customers, " #00000012 ")


@register("customer_recommendations", query("done", """
    SELECT q.user_id, q.product_id, q.customer_id, q.score, q.reason, q.rank, b.name, b.category, b.price FROM recs q
    JOIN brand b ON b.user_id = q.user_id AND b.product_id = q.product_id WHERE q.customer_id = 7
    ORDER BY b.price DESC, q.product_id LIMIT 5""", **BRAND_RECS))
def customer_recommendations(t):
    return analyst.customer_recommendations(brand_recs(t), brand_products(t), 7, "price_desc")

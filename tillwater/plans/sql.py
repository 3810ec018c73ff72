"""Shared common table expressions of the check queries."""

from __future__ import annotations

# Fixed value: the run date of the registered queries, one day after the last order of the tables.
AS_OF = "2001-08-01"
# Fixed value: run date of the earlier model run that the latest-per-customer reads must skip.
EARLIER = "2001-01-01"

CTES = {
    "tenant": "SELECT c_custkey AS customer_id, c_mktsegment AS user_id FROM customer",
    "ord": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' WHEN 'P' THEN 'shipped' END AS status,
        o_totalprice AS total_amount, user_id
        FROM orders JOIN tenant ON o_custkey = tenant.customer_id""",
    "done": "SELECT * FROM ord WHERE status = 'completed'",
    "item": """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
        l_extendedprice / l_quantity AS unit_price, l_extendedprice * l_discount AS discount,
        greatest(0.0, l_extendedprice - l_extendedprice * l_discount) AS total_price FROM lineitem""",
    "catalogue": """SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
        p_retailprice AS price FROM part""",
    "product": "SELECT c.*, t.user_id FROM catalogue c CROSS JOIN (SELECT DISTINCT user_id FROM tenant) t",
    "cust": """SELECT c_mktsegment AS user_id, c_custkey AS customer_id, c_name AS name, n_name AS country
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
}
ORDER = list(CTES)


def r(expr: str, places: int = 2) -> str:
    """Half-up rounding through a decimal; null becomes null."""
    scale = 8 if places <= 2 else 10
    return f"CAST(ROUND(TRY_CAST({expr} AS DECIMAL(38,{scale})), {places}) AS DOUBLE)"


def money(expr: str) -> str:
    return f"COALESCE({r(expr)}, 0.0)"


def xsum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,6))) AS DOUBLE)"


def query(uses: str, body: str, **extra: str) -> str:
    """A statement with the named shared CTEs (plus own ones, in given order) in front of ``body``."""
    wanted = set(uses.split())
    if wanted & {"ord", "done", "product"}:
        wanted.add("tenant")
    if "done" in wanted:
        wanted.add("ord")
    if "product" in wanted:
        wanted.add("catalogue")
    parts = [f"{n} AS ({CTES[n]})" for n in ORDER if n in wanted]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body

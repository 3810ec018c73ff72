"""Registered queries: customer features, churn and lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.operators import analyst, checks, churn, clv, dashboard, features, segments
from tillwater.plans.relational import register
from tillwater.plans.sql import AS_OF, EARLIER, money, query, r, xsum
from tillwater.sources.testdata import Tables


def run_features(t: Tables, as_of: str = AS_OF) -> DataFrame:
    orders = t.completed.filter(F.col("order_date") < F.lit(as_of).cast("timestamp"))
    return features.customer_features(orders, as_of)


def churn_history(t: Tables) -> DataFrame:
    """Two stored runs; reads must use the later one per customer."""
    return churn.predict_churn(run_features(t, EARLIER), EARLIER).unionByName(
        churn.predict_churn(run_features(t), AS_OF)
    )


def clv_history(t: Tables) -> DataFrame:
    return clv.predict_clv(run_features(t, EARLIER), EARLIER).unionByName(clv.predict_clv(run_features(t), AS_OF))


def features_sql(as_of: str = AS_OF) -> str:
    days = lambda a, b: f"greatest(0.0, (epoch_us({a}) - epoch_us({b})) / 86400e6)"
    return f"""SELECT f.user_id, customer_id, {r(days('ref', 'last'))} AS recency, CAST(n AS DOUBLE) AS frequency,
      {money('total')} AS monetary, {money('total / n')} AS aov,
      {r(f"CASE WHEN n >= 2 THEN {days('last', 'first')} / (n - 1) ELSE 0.0 END")} AS avg_gap,
      {r(days('ref', 'first'))} AS tenure
    FROM (SELECT user_id, customer_id, COUNT(*) AS n, {xsum('total_amount')} AS total, MIN(order_date) AS first,
        MAX(order_date) AS last FROM done WHERE order_date < TIMESTAMP '{as_of}' GROUP BY ALL) f
    JOIN (SELECT user_id, greatest(TIMESTAMP '{as_of}', MAX(order_date)) AS ref FROM done
        WHERE order_date < TIMESTAMP '{as_of}' GROUP BY user_id) d ON d.user_id = f.user_id"""


def churn_sql(source: str, as_of: str = AS_OF) -> str:
    norm = lambda m: (
        f"CASE WHEN max_{m} > min_{m} THEN least(1.0, greatest(0.0, ({m} - min_{m}) / (max_{m} - min_{m}))) ELSE 0.0 END"
    )
    score = (
        f"0.35 * ({norm('recency')}) + 0.25 * (1 - ({norm('frequency')})) + 0.15 * (1 - ({norm('monetary')}))"
        f" + 0.15 * ({norm('avg_gap')}) + 0.05 * (1 - ({norm('aov')})) + 0.05 * (1 - ({norm('tenure')}))"
    )
    ranges = ", ".join(
        f"MIN({m}) AS min_{m}, MAX({m}) AS max_{m}" for m in ["recency", "frequency", "monetary", "aov", "avg_gap", "tenure"]
    )
    return f"""SELECT user_id, customer_id, p AS churn_probability,
      CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
      p >= 0.5 AS predicted_churn, 'behavioral-churn-v1' AS model_version, '{as_of}' AS prediction_day
    FROM (SELECT f.user_id, f.customer_id, {r(f'least(1.0, greatest(0.0, {score}))', 4)} AS p
      FROM {source} f JOIN (SELECT user_id, {ranges} FROM {source} GROUP BY user_id) g ON g.user_id = f.user_id)"""


CLV_SQL = f"""SELECT user_id, customer_id,
      {r('''greatest(0.0, 0.25 * monetary + least(24.0, greatest(0.0, frequency / greatest(tenure / 30.0, 1.0) * 12.0))
        * (CASE WHEN aov > 0 THEN aov ELSE monetary / greatest(frequency, 1.0) END)
        * (CASE WHEN recency <= 30 THEN 0.95 WHEN recency <= 60 THEN 0.85 WHEN recency <= 90 THEN 0.70
            WHEN recency <= 180 THEN 0.50 ELSE 0.30 END)
        * (CASE WHEN avg_gap > 0 THEN least(1.0, greatest(0.5, 90.0 / avg_gap)) ELSE 0.60 END))''')} AS predicted_value,
      {r('least(0.95, 0.55 + 0.25 * least(frequency / 10.0, 1.0) + 0.20 * least(tenure / 365.0, 1.0))', 4)} AS confidence_score,
      'behavioral-clv-v1' AS model_version FROM feat"""
FEAT = {"feat": features_sql()}
CHURN = {**FEAT, "churn": churn_sql("feat")}
CLV = {**FEAT, "clv": CLV_SQL}


def features_query(name: str, sql_columns: str, fn):
    @register(name, query("done", f"SELECT user_id, customer_id, {sql_columns} FROM feat", **FEAT))
    def build(t):
        return fn(run_features(t))

    return build


features_query("segmentation_features", "recency, frequency, monetary, aov AS average_order_value",
               features.segmentation_features)
features_query("churn_features", """recency AS recency_days, frequency AS order_frequency, monetary AS monetary_value,
    aov AS average_order_value, avg_gap AS average_days_between_orders, tenure AS customer_tenure_days""",
               features.churn_features)
features_query("clv_features", """recency, frequency AS purchase_frequency, monetary AS total_spent,
    aov AS average_order_value, avg_gap AS average_order_gap, tenure AS customer_age_days""", features.clv_features)


@register("reference_date", query("done", f"""SELECT user_id,
    strftime(greatest(TIMESTAMP '2001-07-15', MAX(order_date)), '%Y-%m-%d') AS reference_day FROM done GROUP BY user_id"""))
def reference_date(t):
    return features.reference_date(t.completed, "2001-07-15").select(
        "user_id", F.date_format("reference_date", "yyyy-MM-dd").alias("reference_day")
    )


@register("churn_predictions", query("done", "SELECT * FROM churn", **CHURN))
def churn_predictions(t):
    p = churn.predict_churn(run_features(t), AS_OF)
    return p.withColumn("prediction_day", F.date_format("prediction_date", "yyyy-MM-dd")).drop("prediction_date")


CHURN_COUNTS = f"""COUNT(*) FILTER (risk_level = 'HIGH') AS high_risk, COUNT(*) FILTER (risk_level = 'MEDIUM') AS medium_risk,
    COUNT(*) FILTER (risk_level = 'LOW') AS low_risk, {money('AVG(CAST(predicted_churn AS INTEGER)) * 100')} AS churn_rate,
    {r('AVG(churn_probability)', 4)} AS average_probability"""


@register("churn_run_summary", query("done", f"""SELECT user_id, COUNT(*) AS customers,
    COUNT(*) FILTER (predicted_churn) AS predicted_churn, {CHURN_COUNTS} FROM churn GROUP BY user_id""", **CHURN))
def churn_run_summary(t):
    return churn.churn_run_summary(churn.predict_churn(run_features(t), AS_OF))


EARLY = {"feat0": features_sql(EARLIER), "churn0": churn_sql("feat0", EARLIER)}
# The later run wins per customer; customers only scored in the earlier run keep that one.
LATEST_CHURN = {**CHURN, **EARLY, "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, customer_id
    ORDER BY prediction_day DESC) AS k FROM (SELECT * FROM churn UNION ALL SELECT * FROM churn0)) WHERE k = 1"""}


@register("churn_dashboard", query("done", f"""SELECT user_id, COUNT(*) AS customer_count, {CHURN_COUNTS},
    COUNT(*) FILTER (predicted_churn) AS predicted_churn_customers FROM latest GROUP BY user_id""", **LATEST_CHURN))
def churn_dashboard(t):
    return dashboard.churn_summary(churn_history(t))


@register("churn_risk_distribution", query("done", f"""
    SELECT a.user_id, a.risk_level, COALESCE(n, 0) AS customers, {money('n / total * 100')} AS percentage
    FROM (SELECT user_id, COUNT(*) AS total, unnest(['HIGH', 'MEDIUM', 'LOW']) AS risk_level FROM latest GROUP BY user_id) a
    LEFT JOIN (SELECT user_id, risk_level, COUNT(*) AS n FROM latest GROUP BY ALL) b
    ON b.user_id = a.user_id AND b.risk_level = a.risk_level""", **LATEST_CHURN))
def churn_risk_distribution(t):
    return dashboard.risk_distribution(churn_history(t))


@register("churn_customer_list", query("done cust", f"""
    SELECT l.user_id, l.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name, churn_probability,
      {money('churn_probability * 100')} AS churn_percentage, risk_level, predicted_churn
    FROM latest l LEFT JOIN cust c ON c.customer_id = l.customer_id AND c.user_id = l.user_id""", **LATEST_CHURN))
def churn_customer_list(t):
    return dashboard.churn_list(churn_history(t), t.customers)


@register("top_churn_customers", query("done", """SELECT user_id, rank, customer_id, churn_probability FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY churn_probability DESC, customer_id) AS rank FROM churn)
    WHERE rank <= 20""", **CHURN))
def top_churn_customers(t):
    return analyst.top_customers(churn.predict_churn(run_features(t), AS_OF), "churn_probability")


@register("risk_fallback", query("done", f"""
    SELECT user_id, customer_id, least(100.0, greatest(0.0, CASE WHEN churn_probability <= 1 THEN churn_probability * 100
        ELSE churn_probability END)) AS percentage,
      CASE WHEN churn_probability * 100 >= 70 THEN 'HIGH' WHEN churn_probability * 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk
    FROM churn""", **CHURN))
def risk_fallback(t):
    p = churn.predict_churn(run_features(t), AS_OF)
    probability = F.col("churn_probability")
    return p.select(
        "user_id", "customer_id", analyst.as_percentage(probability).alias("percentage"),
        analyst.risk_label(F.lit(None).cast("string"), probability).alias("risk"),
    )


@register("summary_kpis", query("ord done cust product", f"""
    SELECT c.user_id, total_customers, total_products, COALESCE(total_orders, 0) AS total_orders,
      {money('rev')} AS total_revenue, {money('rev / nullif(total_orders, 0)')} AS average_order_value,
      {money('rev / nullif(total_customers, 0)')} AS revenue_per_customer, {money('churn_rate')} AS churn_rate,
      COALESCE(high, 0) AS high_risk_customers
    FROM (SELECT user_id, COUNT(*) AS total_customers FROM cust GROUP BY user_id) c
    JOIN (SELECT user_id, COUNT(*) AS total_products FROM product GROUP BY user_id) p ON p.user_id = c.user_id
    LEFT JOIN (SELECT user_id, COUNT(*) AS total_orders, {xsum('total_amount')} AS rev FROM done GROUP BY user_id) d
      ON d.user_id = c.user_id
    LEFT JOIN (SELECT user_id, AVG(CAST(predicted_churn AS INTEGER)) * 100 AS churn_rate,
      COUNT(*) FILTER (risk_level = 'HIGH') AS high FROM latest GROUP BY user_id) l ON l.user_id = c.user_id""",
    **LATEST_CHURN))
def summary_kpis(t):
    return dashboard.summary_kpis(t.customers, t.products, t.completed, churn_history(t))


@register("clv_predictions", query("done", "SELECT * FROM clv", **CLV))
def clv_predictions(t):
    return clv.predict_clv(run_features(t), AS_OF).drop("prediction_date")


def clv_summary_sql(source: str) -> str:
    return f"""SELECT s.user_id, customer_count, {money('total')} AS total_predicted_value, {money('mean')} AS average_predicted_value,
      {money('median')} AS median_predicted_value, confidence AS average_confidence_score, high_value_customers,
      above_average_customers, top.customer_id AS top_customer_id, top.predicted_value AS top_customer_value,
      'behavioral-clv-v1' AS model_version
    FROM (SELECT user_id, COUNT(*) AS customer_count, {xsum('predicted_value')} AS total,
        {xsum('predicted_value')} / COUNT(*) AS mean, median(predicted_value) AS median,
        {r('AVG(confidence_score)', 4)} AS confidence,
        arg_max({{'customer_id': customer_id, 'predicted_value': predicted_value}}, ROW(predicted_value, customer_id)) AS top
      FROM {source} GROUP BY user_id) s
    JOIN (SELECT c.user_id, COUNT(*) FILTER (mean > 0 AND predicted_value >= mean * 1.5) AS high_value_customers,
        COUNT(*) FILTER (predicted_value >= mean) AS above_average_customers
      FROM {source} c JOIN (SELECT user_id, {xsum('predicted_value')} / COUNT(*) AS mean FROM {source} GROUP BY user_id) g
        ON g.user_id = c.user_id GROUP BY c.user_id) h ON h.user_id = s.user_id"""


@register("clv_run_summary", query("done", clv_summary_sql("clv"), **CLV))
def clv_run_summary(t):
    return clv.clv_run_summary(clv.predict_clv(run_features(t), AS_OF))


CLV0 = CLV_SQL.replace("FROM feat", "FROM feat0")
LATEST_CLV = {**CLV, "feat0": features_sql(EARLIER), "clv0": CLV0, "latest": """SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, customer_id ORDER BY run DESC) AS k FROM (SELECT *, 2 AS run FROM clv UNION ALL
    SELECT *, 1 AS run FROM clv0)) WHERE k = 1"""}


@register("clv_dashboard", query("done", clv_summary_sql("latest"), **LATEST_CLV))
def clv_dashboard(t):
    return dashboard.clv_summary(clv_history(t))


@register("clv_customer_list", query("done cust", """
    SELECT l.user_id, l.customer_id, COALESCE(c.name, 'Unknown Customer') AS customer_name, predicted_value, confidence_score
    FROM latest l LEFT JOIN cust c ON c.customer_id = l.customer_id AND c.user_id = l.user_id""", **LATEST_CLV))
def clv_customer_list(t):
    return dashboard.clv_list(clv_history(t), t.customers)


@register("top_clv_customers", query("done", """SELECT user_id, rank, customer_id, predicted_value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_value DESC, customer_id) AS rank FROM clv)
    WHERE rank <= 20""", **CLV))
def top_clv_customers(t):
    return analyst.top_customers(clv.predict_clv(run_features(t), AS_OF), "predicted_value")


@register("churn_result_checks", query("done", """SELECT name, CAST(violations AS BIGINT) AS violations FROM (
    SELECT 'unknown_customer' AS name, COUNT(*) FILTER (customer_id NOT IN (SELECT customer_id FROM tenant)) AS violations FROM churn
    UNION ALL SELECT 'duplicate_customer', COUNT(*) - COUNT(DISTINCT customer_id) FROM churn
    UNION ALL SELECT 'missing_result', (SELECT COUNT(*) FROM feat) - COUNT(*) FROM churn
    UNION ALL SELECT 'probability_range', COUNT(*) FILTER (NOT (churn_probability BETWEEN 0 AND 1)) FROM churn
    UNION ALL SELECT 'risk_level', COUNT(*) FILTER (risk_level NOT IN ('HIGH', 'MEDIUM', 'LOW')) FROM churn
    UNION ALL SELECT 'churn_flag', COUNT(*) FILTER (predicted_churn IS NULL) FROM churn)""", **CHURN))
def churn_result_checks(t):
    feats = run_features(t)
    return checks.churn_checks(churn.predict_churn(feats, AS_OF), feats, t.tenant_of)


@register("clv_result_checks", query("done", """SELECT name, CAST(violations AS BIGINT) AS violations FROM (
    SELECT 'unknown_customer' AS name, COUNT(*) FILTER (customer_id NOT IN (SELECT customer_id FROM tenant)) AS violations FROM clv
    UNION ALL SELECT 'duplicate_customer', COUNT(*) - COUNT(DISTINCT customer_id) FROM clv
    UNION ALL SELECT 'missing_result', (SELECT COUNT(*) FROM feat) - COUNT(*) FROM clv
    UNION ALL SELECT 'value_range', COUNT(*) FILTER (predicted_value < 0) FROM clv
    UNION ALL SELECT 'confidence_range', COUNT(*) FILTER (NOT (confidence_score BETWEEN 0 AND 1)) FROM clv)""", **CLV))
def clv_result_checks(t):
    feats = run_features(t)
    return checks.clv_checks(clv.predict_clv(feats, AS_OF), feats, t.tenant_of)


def segment_history(t: Tables) -> DataFrame:
    """Stored segments of two runs by spend, some without a name."""
    def run(as_of: str) -> DataFrame:
        spend = F.col("monetary")
        name = F.when(spend >= 2_000_000, "High Value").when(spend >= 500_000, "Regular").when(spend >= 200_000, "At Risk")
        return run_features(t, as_of).select(
            "user_id", "customer_id", name.alias("segment_name"), F.lit(as_of).cast("timestamp").alias("created_at")
        )

    return run(EARLIER).unionByName(run(AS_OF))


SEGMENT = """CASE WHEN monetary >= 2000000 THEN 'High Value' WHEN monetary >= 500000 THEN 'Regular'
    WHEN monetary >= 200000 THEN 'At Risk' ELSE 'Unclassified' END"""
SEGMENTS = {**FEAT, "feat0": features_sql(EARLIER), "dist": f"""SELECT user_id, segment, COUNT(*) AS customers,
    {money('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id) * 100')} AS percentage FROM (
      SELECT user_id, {SEGMENT} AS segment FROM (SELECT *, 2 AS run FROM feat UNION ALL SELECT *, 1 FROM feat0)
      QUALIFY row_number() OVER (PARTITION BY user_id, customer_id ORDER BY run DESC) = 1) GROUP BY user_id, segment"""}


@register("customer_distribution", query("done", "SELECT * FROM dist", **SEGMENTS))
def customer_distribution(t):
    return dashboard.customer_distribution(segment_history(t))


@register("dominant_segment", query("done", """SELECT user_id, segment, customers, percentage FROM dist
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY customers DESC, segment DESC) = 1""", **SEGMENTS))
def dominant_segment(t):
    return dashboard.dominant_segment(dashboard.customer_distribution(segment_history(t)))


def spots_sql(feat: str) -> str:
    """Scaled points, as whole millionths of a standard deviation."""
    axes = ["recency", "frequency", "monetary", "aov"]
    place = ", ".join(
        f"CASE WHEN max_{a} > min_{a} THEN CAST(floor(({a} - avg_{a}) / std_{a} * 1000000 + 0.5) AS BIGINT) ELSE 0 END AS x{i}"
        for i, a in enumerate(axes)
    )
    stats = ", ".join(f"AVG({a}) AS avg_{a}, stddev_pop({a}) AS std_{a}, MIN({a}) AS min_{a}, MAX({a}) AS max_{a}" for a in axes)
    return f"""SELECT f.user_id, customer_id, recency, frequency, monetary, {place} FROM {feat} f
      JOIN (SELECT user_id, COUNT(*) AS n, {stats} FROM {feat} GROUP BY user_id) g ON g.user_id = f.user_id AND n >= 2"""


def segment_ctes(feat: str, tag: str = "") -> dict:
    """Lloyd's iteration over all tenants and restarts, from the same first centres."""
    xs = [f"x{i}" for i in range(4)]
    away = " + ".join(f"CAST(p.{x} - c.{x} AS DOUBLE) * CAST(p.{x} - c.{x} AS DOUBLE)" for x in xs)
    near = f"""SELECT p.user_id, c.restart, p.customer_id, {", ".join(f"p.{x}" for x in xs)},
        arg_min(c.i, ROW({away}, c.i)) AS i, MIN({away}) AS d FROM spots{tag} p JOIN {{centres}} c ON c.user_id = p.user_id {{only}}
        GROUP BY p.user_id, c.restart, p.customer_id, {", ".join(f"p.{x}" for x in xs)}"""
    key = "md5(CAST(restart AS VARCHAR) || ':' || CAST(customer_id AS VARCHAR))"
    farthest = f"""SELECT user_id, restart, {{i}}, {", ".join(f"b.{x}" for x in xs)} FROM (
        SELECT user_id, restart, arg_max({{{{{", ".join(f"'{x}': {x}" for x in xs)}}}}}, ROW(d, {key})) AS b
        FROM ({near.format(centres="{of}", only="")}) GROUP BY user_id, restart)"""
    old = ", ".join(f"c.{x} AS o{x}, COALESCE(CAST(floor(s.{x} / s.n + 0.5) AS BIGINT), c.{x}) AS {x}" for x in xs)
    shift = " + ".join(f"CAST(o{x} - {x} AS DOUBLE) * CAST(o{x} - {x} AS DOUBLE)" for x in xs)
    return {
        f"spots{tag}": spots_sql(feat),
        f"drawn{tag}": f"""SELECT user_id, restart, row_number() OVER (PARTITION BY user_id, restart ORDER BY {key}, customer_id) - 1 AS i,
            {", ".join(xs)} FROM spots{tag}, (SELECT unnest(range(10)) AS restart) QUALIFY i < 3""",
        f"one{tag}": f"SELECT * FROM drawn{tag} WHERE restart % 2 = 1 AND i = 0",
        f"two{tag}": f"SELECT * FROM one{tag} UNION ALL " + farthest.format(i=1, of=f"one{tag}"),
        f"three{tag}": f"SELECT * FROM two{tag} UNION ALL " + farthest.format(i=2, of=f"two{tag}"),
        f"lloyd{tag}": f"""SELECT user_id, restart, i, {", ".join(xs)}, 0 AS turn, true AS going
            FROM (SELECT * FROM drawn{tag} WHERE restart % 2 = 0 UNION ALL SELECT * FROM three{tag})
          UNION ALL
          SELECT user_id, restart, i, {", ".join(xs)}, turn + 1, SUM({shift}) OVER (PARTITION BY user_id, restart) > 1e8 AND turn < 299
          FROM (SELECT c.user_id, c.restart, c.i, c.turn, {old} FROM lloyd{tag} c LEFT JOIN (
              SELECT user_id, restart, i, COUNT(*) AS n, {", ".join(f"SUM({x}) AS {x}" for x in xs)}
              FROM ({near.format(centres=f"lloyd{tag}", only="AND c.going")}) GROUP BY user_id, restart, i
            ) s ON s.user_id = c.user_id AND s.restart = c.restart AND s.i = c.i WHERE c.going)""",
        f"settled{tag}": f"SELECT * FROM lloyd{tag} QUALIFY rank() OVER (PARTITION BY user_id, restart ORDER BY turn DESC) = 1",
        f"assigned{tag}": near.format(centres=f"settled{tag}", only=""),
        f"best{tag}": f"""SELECT user_id, arg_min(restart, ROW(cost, restart)) AS restart FROM (
            SELECT user_id, restart, SUM(CAST(d AS DECIMAL(38,0))) AS cost FROM assigned{tag} GROUP BY ALL) GROUP BY user_id""",
        f"clustered{tag}": f"""SELECT a.user_id, a.customer_id, a.i, p.recency, p.frequency, p.monetary FROM assigned{tag} a
            JOIN best{tag} b ON b.user_id = a.user_id AND b.restart = a.restart
            JOIN spots{tag} p ON p.user_id = a.user_id AND p.customer_id = a.customer_id""",
        f"named{tag}": f"""SELECT *, CASE row_number() OVER (PARTITION BY user_id ORDER BY score DESC, i)
            WHEN 1 THEN 'High Value' WHEN 2 THEN 'Regular' ELSE 'At Risk' END AS segment_name FROM (
            SELECT user_id, i, {xsum('monetary')} / COUNT(*) + 100 * ({xsum('frequency')} / COUNT(*))
              - 10 * ({xsum('recency')} / COUNT(*)) AS score FROM clustered{tag} GROUP BY user_id, i)""",
    }


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("customer_segments", recursive(query("done", f"""SELECT c.user_id, c.customer_id, n.segment_name,
    CAST(c.i AS INTEGER) AS cluster_number, {r('n.score', 4)} AS score, '{AS_OF}' AS created_day
    FROM clustered c JOIN named n ON n.user_id = c.user_id AND n.i = c.i""", **FEAT, **segment_ctes("feat"))))
def customer_segments(t):
    """Segments of every tenant's customers."""
    base = features.segmentation_features(run_features(t))
    found = segments.accepted(segments.segment(base, AS_OF), base)
    return found.withColumn("created_day", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")

"""Registered queries over stored runs: ledger, published tables, notifications, name index, and checks that find something."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwater.functions import arrays
from tillwater.functions.scalars import iso_day, money as m
from tillwater.operators import basket, checks, churn, dashboard, explain, features, notify, segments
from tillwater.plans import baskets, forecasts, scoring
from tillwater.plans.relational import DATASETS_SQL, datasets, register
from tillwater.plans.sql import AS_OF, EARLIER, money, query
from tillwater.session import ensure_checkpoint_dir, stored
from tillwater.sources.ledger import NameIndex, NotificationStore, Published, RunLedger
from tillwater.sources.schemas import MARKET_BASKET_RULES
from tillwater.sources.testdata import Tables

# The days of the recorded runs.
BEFORE, AFTER = "2001-07-31", "2001-08-02"


def folder(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_segments(t: Tables, as_of: str, at: str) -> DataFrame:
    base = features.segmentation_features(scoring.run_features(t, as_of))
    return segments.accepted(segments.segment(base, at), base)


@register("activity_feed", forecasts.point_rows(f"""
    SELECT user_id, id, type, title, description, strftime(ts, '%Y-%m-%d') AS day, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) AS rank FROM feed) WHERE rank <= 10""",
    ds=DATASETS_SQL, **scoring.FEAT, feed=f"""
      SELECT user_id, 'dataset-' || dataset_id AS id, 'dataset' AS type, 'Dataset imported' AS title,
        name || ' — ' || CAST(row_count AS VARCHAR) || ' rows' AS description, uploaded_at AS ts FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, dataset_id DESC) AS k FROM ds) WHERE k <= 3
      UNION ALL
      SELECT user_id, 'order-' || CAST(order_id AS VARCHAR), 'order', 'Order processed', CAST(order_id AS VARCHAR) || ' — ' ||
        regexp_replace(CAST(CAST({money('total_amount')} AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', ''), order_date FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC, order_id DESC) AS k FROM ord) WHERE k <= 3
      UNION ALL
      SELECT user_id, 'segmentation-latest', 'segmentation', 'Customer segmentation completed',
        'Customer segmentation model results were generated.', TIMESTAMP '{BEFORE}' FROM feat GROUP BY user_id HAVING COUNT(*) >= 2
      UNION ALL
      SELECT DISTINCT user_id, 'churn-latest', 'churn', 'Churn prediction completed',
        'Customer churn probabilities were updated.', TIMESTAMP '{AS_OF}' FROM feat
      UNION ALL
      SELECT DISTINCT user_id, 'forecast-latest', 'forecast', 'Sales forecast generated',
        'Revenue forecasting results were updated.', TIMESTAMP '{AFTER}' FROM points"""))
def activity_feed(t):
    """The feed reads the runs of the three models from the ledger that the models wrote."""
    ledger = RunLedger(t.spark, folder(t, "ledger"))
    ledger.record("churn", "1", EARLIER, churn.predict_churn(scoring.run_features(t, EARLIER), EARLIER))
    ledger.record("segmentation", "1", BEFORE, run_segments(t, AS_OF, BEFORE))
    ledger.record("churn", "2", AS_OF, churn.predict_churn(scoring.run_features(t), AS_OF))
    ledger.record("forecast", "1", AFTER, forecasts.stored_forecast(t))
    runs = [(kind, ledger.runs(kind), "at") for kind in ("segmentation", "churn", "forecast")]
    feed = dashboard.activity_feed(datasets(t), t.orders, runs)
    return feed.withColumn("day", iso_day(F.col("timestamp"))).withColumn("rank", F.col("rank").cast("long")).drop("timestamp")


@register("segment_distribution", scoring.recursive(query("done", f"""SELECT user_id, segment, COUNT(*) AS customers,
    {money('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id) * 100')} AS percentage FROM (
      SELECT * FROM ({" UNION ALL ".join(
        f"SELECT c.user_id, c.customer_id, n.segment_name AS segment, {run} AS run FROM clustered{tag} c "
        f"JOIN named{tag} n ON n.user_id = c.user_id AND n.i = c.i" for run, tag in ((2, ""), (1, "0")))})
      QUALIFY row_number() OVER (PARTITION BY user_id, customer_id ORDER BY run DESC) = 1) GROUP BY user_id, segment""",
    **scoring.FEAT, feat0=scoring.features_sql(EARLIER), **scoring.segment_ctes("feat"), **scoring.segment_ctes("feat0", "0"))))
def segment_distribution(t):
    """Distribution over the latest segment of each customer in two recorded runs."""
    ledger = RunLedger(t.spark, folder(t, "ledger"))
    # The rounds of the two runs are many small jobs, which run side by side.
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda as_of: run_segments(t, as_of, as_of), (EARLIER, AS_OF)))
    for run, (as_of, found) in enumerate(zip((EARLIER, AS_OF), runs)):
        ledger.record("segmentation", str(run), as_of, found)
    return dashboard.customer_distribution(ledger.history("segmentation"))


@register("notification_runs", forecasts.point_rows("""SELECT n.user_id, run, CASE WHEN run = 1 THEN n ELSE 0 END AS created,
    CASE WHEN run = 1 THEN 0 ELSE n END AS skipped, n AS kept FROM (SELECT user_id, COUNT(*) AS n FROM notes GROUP BY user_id) n,
    (SELECT unnest([1, 2, 3]) AS run)""", **forecasts.ALL_NOTES))
def notification_runs(t):
    """Three runs of one batch into the persisted store: the second and the third add nothing."""
    store = NotificationStore(t.spark, folder(t, "notifications"))
    sections, pts = forecasts.all_insights(t)
    batch = stored(notify.candidates(sections["risks"], sections["recommendations"], explain.explain_days(pts)))
    out = None
    for run in (1, 2, 3):
        created, skipped = store.insert(batch, f"r{run}", BEFORE)
        n = created.groupBy("user_id").agg(F.count(F.lit(1)).alias("created"))
        s = skipped.groupBy("user_id").agg(F.sum("times").alias("skipped"))
        kept = store.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
        row = kept.join(n, "user_id", "left").join(s, "user_id", "left").select(
            "user_id", F.lit(run).cast("long").alias("run"), F.coalesce("created", F.lit(0)).alias("created"),
            F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"), "kept",
        )
        out = stored(row) if out is None else out.unionByName(stored(row))
    return out


@register("published_rules", query("done", "SELECT * FROM named", **baskets.TYPE_RULES))
def published_rules(t):
    """Rules as read back from the published table, after a first version with other rules was replaced."""
    table = Published(t.spark, folder(t, "rules"), MARKET_BASKET_RULES)
    sets = stored(basket.frequent_itemsets(baskets.type_transactions(t)))
    table.replace(basket.association_rules(sets, 0.9))
    table.replace(basket.association_rules(sets), t.tenant_of.select("user_id").distinct())
    return table.read().withColumn("antecedent", baskets.joined("antecedent")).withColumn("consequent", baskets.joined("consequent"))


@register("name_search", query("cust", "SELECT user_id, customer_id, name FROM cust WHERE contains(lower(name), '#0000001')"))
def name_search(t):
    index = NameIndex(t.spark, folder(t, "names"))
    index.build(t.customers)
    return index.search(" #0000001 ")


# ---- checks and rules that find something ----
TOTALS = """SELECT user_id, customer_id, list(greatest(total_amount, 0.0) ORDER BY order_id) AS v FROM done GROUP BY ALL"""
MEDIANS = """SELECT *, list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM (
    SELECT *, list_median(l) AS m FROM (SELECT user_id, customer_id, list_transform(v, lambda x: ln(1 + x)) AS l FROM totals))"""


@register("order_spikes", query("done", f"""SELECT d.user_id, d.customer_id, d.order_id, {money('d.total_amount')} AS total_amount FROM done d
    JOIN medians s ON s.user_id = d.user_id AND s.customer_id = d.customer_id
    WHERE s.mad > 1e-9 AND ln(1 + greatest(d.total_amount, 0.0)) > s.m + 3 * 1.4826 * s.mad""", totals=TOTALS, medians=MEDIANS))
def order_spikes(t):
    """Orders far above the customer's usual ones, by the rule that marks spike days."""
    own = t.completed.groupBy("user_id", "customer_id").agg(F.array_sort(F.collect_list(F.struct("order_id", "total_amount"))).alias("o"))
    capped = own.withColumn("cap", arrays.spike_limit(F.transform("o", lambda x: x["total_amount"])))
    found = F.filter("o", lambda x: arrays.is_spike(x["total_amount"], F.col("cap")))
    return capped.select("user_id", "customer_id", F.explode(found).alias("o")).select(
        "user_id", "customer_id", "o.order_id", m(F.col("o.total_amount")).alias("total_amount")
    )


@register("completed_history_quality", query("done", """SELECT user_id, observed_days, calendar_days,
    calendar_days - observed_days AS missing_days, ROUND(CAST(observed_days / calendar_days AS DECIMAL(38,10)), 4)::DOUBLE AS coverage,
    CASE WHEN observed_days = 1 THEN 'insufficient' WHEN observed_days / calendar_days >= 0.9 THEN 'high'
      WHEN observed_days / calendar_days >= 0.7 THEN 'medium' ELSE 'low' END AS quality
    FROM (SELECT user_id, COUNT(DISTINCT CAST(order_date AS DATE)) AS observed_days,
      date_diff('day', MIN(CAST(order_date AS DATE)), MAX(CAST(order_date AS DATE))) + 1 AS calendar_days
      FROM done GROUP BY user_id)"""))
def completed_history_quality(t):
    return dashboard.history_quality(t.completed)


@register("notification_violations", query("cust", """SELECT name, CAST(n AS BIGINT) AS violations FROM (
    SELECT 'user_id' AS name, COUNT(*) FILTER (user_id = 'BUILDING') AS n FROM cust
    UNION ALL SELECT 'type', 0 UNION ALL SELECT 'title', COUNT(*) FILTER (country = 'FRANCE' OR country IS NULL) FROM cust
    UNION ALL SELECT 'message', COUNT(*) FILTER (customer_id % 10 = 3) FROM cust)"""))
def notification_violations(t):
    """The rules for notifications over rows of which some break them."""
    rows = t.customers.select(
        F.when(F.col("user_id") != "BUILDING", F.col("user_id")).alias("user_id"), F.lit("risk").alias("type"),
        F.when(F.col("country") != "FRANCE", F.col("country")).alias("title"),
        F.when(F.col("customer_id") % 10 == 3, "  ").otherwise(F.col("name")).alias("message"),
    )
    return checks.notification_checks(rows)

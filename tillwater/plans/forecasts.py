"""Registered queries: daily series, forecasts, evaluation, insights, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwater.functions import arrays
from tillwater.functions.scalars import iso_day, rounded
from tillwater.operators import analyst, checks, dashboard, explain, insights, notify
from tillwater.operators.forecast import evaluate, model, older, series
from tillwater.plans.forecast_sql import LEGACY, backtest_ctes, model_ctes, points_ctes, wmean
from tillwater.plans.insight_sql import ADVICE, EXPLAINED, NOTES, risks
from tillwater.plans.relational import DAILY, register
from tillwater.plans.sql import money, query, r, xsum
from tillwater.session import stored
from tillwater.sources.testdata import Tables

# Fixed value: last day of the history of the registered forecasts.
END = "2001-07-31"
HORIZON = 30


def history(t: Tables) -> DataFrame:
    return series.order_history(t.completed, END)


def predicted(t: Tables, horizon: int = HORIZON) -> DataFrame:
    return model.run(series.as_arrays(history(t)), horizon)


def points(t: Tables) -> DataFrame:
    return model.forecast_points(predicted(t))


def event_points(t: Tables) -> DataFrame:
    """Purchases of the event stream as given points of one series per customer."""
    return t.raw("events").filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("user_id"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("revenue"),
        F.lit(1.0).alias("orders"),
    )


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, iso_day(F.col(c)))
    return df


HISTORY = f"""SELECT c.user_id, c.date, {money('b.rev')} AS revenue, COALESCE(b.n, 0) AS orders, b.n IS NOT NULL AS observed
    FROM (SELECT u.user_id, CAST(g.d AS DATE) AS date FROM (SELECT DISTINCT user_id FROM done
        WHERE order_date >= DATE '{END}' - 89) u
      CROSS JOIN (SELECT unnest(generate_series(DATE '{END}' - 89, DATE '{END}', INTERVAL 1 DAY)) AS d) g) c
    LEFT JOIN (SELECT user_id, CAST(order_date AS DATE) AS date, {xsum('total_amount')} AS rev, COUNT(*) AS n
      FROM done GROUP BY ALL) b ON b.user_id = c.user_id AND b.date = c.date"""
HIST = {"hist": HISTORY}


@register("sales_history", query("done", "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM hist", **HIST))
def sales_history(t):
    return day_text(history(t), "date")


@register("series_quality", query("done", f"""SELECT user_id, o AS observed_days, n AS calendar_days, n - o AS missing_days,
    {r('o / n', 4)} AS coverage, CASE WHEN o >= 30 THEN 'high' WHEN o >= 14 THEN 'medium' ELSE 'low' END AS quality,
    CASE WHEN o >= 30 THEN 'high' WHEN o >= 14 THEN 'medium' ELSE 'low' END AS confidence, o < 14 OR o / n < 0.5 AS is_sparse
    FROM (SELECT user_id, COUNT(*) FILTER (observed) AS o, COUNT(*) AS n FROM hist GROUP BY user_id)""", **HIST))
def series_quality(t):
    return series.series_quality(history(t))


EVENTS = f"""SELECT s.user_id, s.date, COALESCE(b.rev, 0.0) AS revenue, COALESCE(b.n, 0.0) AS orders, COALESCE(b.seen, false) AS observed
    FROM (SELECT user_id, CAST(unnest(generate_series(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date
      FROM events WHERE event_type = 'purchase' GROUP BY user_id) s
    LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, CAST(SUM(CAST(greatest(value, 0.0) AS DECIMAL(28,6))) AS DOUBLE) AS rev,
      CAST(COUNT(*) AS DOUBLE) AS n, bool_or(value > 0) AS seen FROM events WHERE event_type = 'purchase' GROUP BY ALL) b
    ON b.user_id = s.user_id AND b.date = s.date"""


@register("event_series", query("", f"""SELECT user_id, strftime(date, '%Y-%m-%d') AS date, {r('revenue')} AS revenue, orders, observed
    FROM ev""", ev=EVENTS))
def event_series(t):
    return day_text(series.normalise(event_points(t)), "date").withColumn("revenue", rounded(F.col("revenue"), 2))


def med(a: str) -> str:
    return f"list_median({a})"


def quant(a: str, q: float) -> str:
    return f"list_aggregate({a}, 'quantile_cont', {q})"


LOGS = """SELECT user_id, list(revenue ORDER BY date) AS v, list(ln(1 + greatest(revenue, 0)) ORDER BY date) AS l
    FROM hist WHERE observed GROUP BY user_id"""
SPIKE_STATS = f"""SELECT *, {med('l')} AS m, {med('list_transform(l, lambda x: abs(x - list_median(l)))')} AS mad FROM logs"""


@register("revenue_spikes", query("done", f"""SELECT h.user_id, strftime(h.date, '%Y-%m-%d') AS date, h.revenue
    FROM hist h JOIN stats s ON s.user_id = h.user_id
    WHERE h.observed AND s.mad > 1e-9 AND ln(1 + h.revenue) > s.m + 3 * 1.4826 * s.mad""",
    **HIST, logs=LOGS, stats=SPIKE_STATS))
def revenue_spikes(t):
    a = series.as_arrays(history(t)).withColumn("obs", F.filter("hist", lambda d: d["observed"]))
    cap = arrays.spike_limit(F.transform("obs", lambda d: d["revenue"]))
    a = a.withColumn("cap", cap)
    found = F.filter("obs", lambda d: arrays.is_spike(d["revenue"], F.col("cap")))
    return day_text(a.select("user_id", F.explode(found).alias("d")).select("user_id", "d.date", "d.revenue"), "date")


WINSOR = f"""CASE WHEN len(v) >= 5 AND {quant('v', 0.90)} > {quant('v', 0.05)}
    THEN list_transform(v, lambda x: least(greatest(x, {quant('v', 0.05)}), {quant('v', 0.90)})) ELSE v END"""
ROBUST = """CASE WHEN len(v) >= 3 AND list_median(list_transform(v, lambda x: abs(x - list_median(v)))) > 0
    THEN list_transform(v, lambda x: least(greatest(x,
      list_median(v) - 3 * 1.4826 * list_median(list_transform(v, lambda y: abs(y - list_median(v))))),
      list_median(v) + 3 * 1.4826 * list_median(list_transform(v, lambda y: abs(y - list_median(v)))))) ELSE v END"""


@register("robust_baselines", query("done", f"""
    SELECT user_id, {r("exp(list_sum(list_transform(w, lambda x, i: ln(1 + x) * i)) / (len(w) * (len(w) + 1) / 2.0)) - 1")} AS log_baseline,
      {r("list_sum(list_transform(w, lambda x, i: x * i)) / (len(w) * (len(w) + 1) / 2.0)")} AS winsorised_mean,
      {r("list_sum(list_transform(c, lambda x, i: x * i)) / (len(c) * (len(c) + 1) / 2.0)")} AS clipped_mean,
      {r(med('v'))} AS median, {r(quant('v', 0.9))} AS q90, {r("list_aggregate(v, 'stddev_samp')")} AS spread
    FROM (SELECT user_id, v, {WINSOR} AS w, {ROBUST} AS c FROM logs)""", **HIST, logs=LOGS))
def robust_baselines(t):
    a = series.as_arrays(history(t)).withColumn(
        "v", F.transform(F.filter("hist", lambda d: d["observed"]), lambda d: d["revenue"])
    ).filter(F.size("v") > 0)
    v = F.col("v")
    return a.select(
        "user_id",
        rounded(arrays.log_baseline(v), 2).alias("log_baseline"),
        rounded(arrays.weighted_mean(arrays.winsorised(v)), 2).alias("winsorised_mean"),
        rounded(arrays.weighted_mean(arrays.robust_clipped(v)), 2).alias("clipped_mean"),
        rounded(arrays.median(v), 2).alias("median"),
        rounded(arrays.quantile(v, 0.9), 2).alias("q90"),
        rounded(arrays.stddev(v), 2).alias("spread"),
    )


MODEL = {**HIST, **model_ctes(HORIZON)}
POINTS = {**MODEL, **points_ctes()}
BACKTEST = {**MODEL, **backtest_ctes()}


def point_rows(body: str, **extra: str) -> str:
    return query("done", body, **POINTS, **extra)


def ymd(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


@register("sales_forecast", point_rows(f"SELECT * REPLACE ({ymd('forecast_date')}) FROM points"))
def sales_forecast(t):
    return day_text(points(t), "forecast_date")


TWO = {"aov": "aov", "revenue_lag1": "r1", "revenue_lag7": "r7", "orders_lag1": "o1", "orders_lag7": "o7", "aov_lag1": "a1",
       "aov_lag7": "a7", "revenue_rolling7": "rr", "aov_rolling7": "ar"}
FOUR = {"revenue_trend": "rt", "order_trend": "ot", "aov_trend": "atr"}


@register("forecast_diagnostics", query("done", f"""SELECT e.user_id, {r('base', 3)} AS order_baseline, w.fo AS weekday_factors,
    w.fa AS aov_weekday_factors, spike_days, COALESCE(spikes, 0) AS spike_count_recent, {r('oo', 3)} AS orders_rolling7,
    CAST(damp AS DOUBLE) AS damping, {", ".join(f"{r(v)} AS {k}" for k, v in TWO.items())},
    {", ".join(f"{r(v, 4)} AS {k}" for k, v in FOUR.items())}
    FROM e5 e JOIN (SELECT user_id, known, string_agg(CAST({r('fo', 4)} AS VARCHAR), '|' ORDER BY wd) AS fo,
      string_agg(CAST({r('fa', 4)} AS VARCHAR), '|' ORDER BY wd) AS fa FROM wk GROUP BY ALL) w
    ON w.user_id = e.user_id AND w.known = e.known WHERE e.adate IS NULL""", **MODEL))
def forecast_diagnostics(t):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)
    d = model.diagnostics(predicted(t, 1))
    return d.withColumn("weekday_factors", joined("weekday_factors")).withColumn(
        "aov_weekday_factors", joined("aov_weekday_factors")
    )


ERRORS = ", ".join(f"""{r(m)} AS {m}_prediction, {r(f'abs(actual - {m})')} AS {m}_absolute_error,
    {r(f'abs(actual - {m}) / nullif(abs(actual), 0) * 100')} AS {m}_error_percent""" for m in ("v4", "v4_1", "baseline"))


@register("forecast_backtest", query("done", f"""SELECT user_id, {ymd('date')}, dayname(bt.date) AS weekday, {r('actual')} AS actual_revenue,
    {ERRORS}, CAST(orders AS BIGINT) AS orders, {r('actual / nullif(orders, 0)')} AS aov FROM bt""", **BACKTEST))
def forecast_backtest(t):
    return day_text(evaluate.evaluation_days(evaluate.backtest(predicted(t, 1))), "date")


METRIC_NAMES = ["mae", "rmse", "mape", "wape", "smape"]
RUN = ", ".join(f"{r(m, 4)} AS {m}" for m in METRIC_NAMES)


@register("forecast_metrics", query("done", f"""SELECT user_id, evaluation_days, {RUN}, {r('baseline_wape', 4)} AS baseline_wape,
    {r('v4_wape', 4)} AS v4_wape FROM metrics""", **BACKTEST))
def forecast_metrics(t):
    return evaluate.rounded_metrics(evaluate.metrics(evaluate.backtest(predicted(t, 1))))


def gain(old: str, new: str) -> str:
    return r(f"({old} - {new}) / nullif({old}, 0) * 100")


@register("model_comparison", query("done", f"""SELECT user_id, {r('baseline_wape', 4)} AS baseline_wape, {r('v4_wape', 4)} AS v4_wape,
    {r('wape', 4)} AS v4_1_wape, {gain('baseline_wape', 'v4_wape')} AS v4_over_baseline, {gain('baseline_wape', 'wape')} AS v4_1_over_baseline,
    {gain('v4_wape', 'wape')} AS v4_1_over_v4, CASE WHEN baseline_wape <= v4_wape AND baseline_wape <= wape THEN 'baseline'
      WHEN v4_wape <= wape THEN 'v4' ELSE 'v4_1' END AS best_model FROM metrics""", **BACKTEST))
def model_comparison(t):
    return evaluate.comparison(evaluate.metrics(evaluate.backtest(predicted(t, 1))))


@register("evaluation_reliability", query("done", """SELECT user_id, evaluation_days,
    CASE WHEN evaluation_days >= 14 THEN 'reliable' ELSE 'limited' END AS status,
    CASE WHEN evaluation_days >= 14 THEN 'high' WHEN evaluation_days >= 7 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN evaluation_days < 14 THEN 'Forecast accuracy evaluation is based on a limited number of observed holdout days.' END AS message
    FROM metrics""", **BACKTEST))
def evaluation_reliability(t):
    return evaluate.reliability(evaluate.metrics(evaluate.backtest(predicted(t, 1))))


OLDER = {
    **HIST, **{k: v for k, v in model_ctes().items() if k in ("idx", "cut", "tr", "e1", "e2")},
    "base": f"""SELECT *, CASE WHEN list_sum(ords) > 0 THEN {wmean('ords[-14:]')} END AS order_base FROM (
      SELECT *, list_transform(t, lambda x: floor(x.o)) AS ords FROM e2 WHERE adate IS NULL)""",
    "lg": """SELECT user_id, step AS known, rev, obs, nd, date, isodow(date) - 1 AS wd FROM (
      SELECT *, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date FROM (SELECT *, unnest(range(1, 31)) AS step FROM base))""",
    **{k: v for k, v in LEGACY.items() if k != "legacy"},
    "o1": """SELECT *, least(greatest(greatest(0.0, b + slope * known) * f, 0.5 * b * f), greatest(1.5 * b * f, b * f + min_error)) AS p FROM g4""",
    "o2": "SELECT *, greatest(0.10 * b * f, 1.0, p * least(0.25, 0.10 + known / 30.0 * 0.15)) AS reach FROM o1",
    "steps": """SELECT user_id, 1 AS k, order_base, floor(order_base) AS c, order_base - floor(order_base) AS rest FROM base
      UNION ALL SELECT user_id, k + 1, order_base, floor(rest + order_base), rest + order_base - floor(rest + order_base) FROM steps WHERE k < 30""",
}


@register("older_forecast", query("done", f"""SELECT o.user_id, strftime(o.date, '%Y-%m-%d') AS forecast_date, {r('p')} AS predicted_revenue,
    CAST(s.c AS BIGINT) AS predicted_orders, {r('greatest(0.0, p - reach)')} AS lower_bound, {r('p + reach')} AS upper_bound,
    'sales-forecast-v2' AS model_version FROM o2 o JOIN steps s ON s.user_id = o.user_id AND s.k = o.known""", **OLDER).replace("WITH ", "WITH RECURSIVE ", 1))
def older_forecast(t):
    return day_text(older.forecast(series.as_arrays(history(t)), HORIZON), "forecast_date")


OLDER_BACKTEST = {**HIST, **{k: v for k, v in model_ctes(1, 14, 3).items() if k in ("idx", "cut", "tr", "e1", "e2")},
                  "lg": "SELECT user_id, known, rev, obs, nd, isodow(adate) - 1 AS wd FROM e2 WHERE adate IS NOT NULL AND len(rev) > 0",
                  **{k: v for k, v in backtest_ctes().items() if k.startswith("g") or k == "legacy"}}


@register("older_backtest", query("done", f"""SELECT l.user_id, strftime(e.adate, '%Y-%m-%d') AS date, e.actual, {r('l.baseline')} AS predicted
    FROM legacy l JOIN e2 e ON e.user_id = l.user_id AND e.known = l.known""", **OLDER_BACKTEST))
def older_backtest(t):
    b = older.backtest(series.as_arrays(history(t)))
    return day_text(b, "date").withColumn("predicted", rounded(F.col("predicted"), 2))


def stored_forecast(t: Tables) -> DataFrame:
    p = stored(predicted(t))
    return evaluate.stored_forecast(model.forecast_points(p), evaluate.metrics(evaluate.backtest(p)), END)


STORED = {**POINTS, **backtest_ctes(), "kept": f"""SELECT p.* EXCLUDE (v4_revenue, v4_orders, v4_aov), {RUN},
    COALESCE(evaluation_days, 0) AS evaluation_days, 'orders-times-dynamic-aov-robust-seasonal-trend-adjusted' AS algorithm,
    'sales-forecast-v4.1' AS model_version, '{END}' AS generated_at FROM points p LEFT JOIN metrics m ON m.user_id = p.user_id"""}


@register("stored_forecast", query("done", f"SELECT * REPLACE ({ymd('forecast_date')}) FROM kept", **STORED))
def stored_forecast_rows(t):
    return day_text(stored_forecast(t), "forecast_date", "generated_at")


@register("forecast_dashboard", query("done", f"""SELECT user_id, COUNT(*) AS horizon, {money(xsum('predicted_revenue'))} AS total_predicted_revenue,
    any_value(model_version) AS model_version, any_value(algorithm) AS algorithm, any_value(evaluation_days) AS evaluation_days,
    {", ".join(f"any_value({m}) AS {m}" for m in METRIC_NAMES)},
    CASE WHEN any_value(evaluation_days) < 7 THEN 'insufficient' WHEN any_value(evaluation_days) < 14 THEN 'limited' ELSE 'reliable' END AS evaluation_status,
    CASE WHEN any_value(evaluation_days) < 14 THEN 'low' WHEN any_value(evaluation_days) < 30 THEN 'medium' ELSE 'high' END AS evaluation_confidence
    FROM kept GROUP BY user_id""", **STORED))
def forecast_dashboard(t):
    return dashboard.forecast_metadata(stored_forecast(t))


@register("forecast_chart", point_rows(f"""SELECT user_id, strftime(day, '%Y-%m-%d') AS date, 'history' AS kind, revenue, CAST(orders AS DOUBLE) AS orders,
    CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM daily
    UNION ALL SELECT user_id, strftime(forecast_date, '%Y-%m-%d'), 'forecast', predicted_revenue, CAST(predicted_orders AS DOUBLE), lower_bound, upper_bound
    FROM points""", daily=DAILY))
def forecast_chart(t):
    return day_text(dashboard.forecast_chart(dashboard.daily_revenue(t.completed), points(t)), "date")


@register("forecast_checks", point_rows("""SELECT unnest(['finite_revenue', 'finite_orders', 'finite_aov', 'reconciles', 'bounds']) AS name,
    unnest([COUNT(*) FILTER (predicted_revenue IS NULL), COUNT(*) FILTER (predicted_orders IS NULL), COUNT(*) FILTER (predicted_aov IS NULL),
      COUNT(*) FILTER (abs(predicted_orders * predicted_aov - predicted_revenue) > 1), COUNT(*) FILTER (lower_bound > upper_bound)]) AS violations
    FROM points"""))
def forecast_checks(t):
    return checks.forecast_checks(points(t))


RANKED = {"ranked": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY forecast_date) AS rn FROM points"}


@register("next_week", point_rows(f"""SELECT *, {money('revenue / nullif(orders, 0)')} AS aov FROM (
    SELECT user_id, {money(xsum('predicted_revenue'))} AS revenue, CAST(SUM(predicted_orders) AS BIGINT) AS orders
    FROM ranked WHERE rn <= 7 GROUP BY user_id)""", **RANKED))
def next_week(t):
    return analyst.next_week(points(t))


@register("confidence_band", point_rows(f"""SELECT user_id, {ymd('forecast_date')}, {money('upper_bound - lower_bound')} AS band_width,
    {money('AVG(predicted_revenue) OVER (PARTITION BY user_id)')} AS mean_revenue FROM points"""))
def confidence_band(t):
    return day_text(analyst.confidence_band(points(t)), "forecast_date")


@register("latest_forecast_rows", point_rows(f"""SELECT * REPLACE ({ymd('forecast_date')}) FROM points p
    ORDER BY p.forecast_date DESC, user_id LIMIT 5"""))
def latest_forecast_rows(t):
    return day_text(points(t).orderBy(F.desc("forecast_date"), "user_id").limit(5), "forecast_date")


def all_insights(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    daily = history(t)
    p = stored(predicted(t))
    pts = model.forecast_points(p)
    coverage = dashboard.history_quality(
        t.completed.filter(F.col("order_date") >= F.date_sub(F.lit(END).cast("date"), series.LOOKBACK_DAYS - 1).cast("timestamp"))
    )
    return insights.insights(pts, daily, coverage, model.diagnostics(p)), pts


@register("revenue_outlook", point_rows(f"""SELECT user_id, {r('SUM(predicted_revenue) FILTER (rn <= 7)')} AS next_7_days,
    {r('SUM(predicted_revenue)')} AS next_30_days, {r('AVG(predicted_revenue)')} AS average_daily_revenue,
    strftime(arg_max(forecast_date, ROW(predicted_revenue, -rn)), '%Y-%m-%d') AS peak_date, MAX(predicted_revenue) AS peak_revenue,
    strftime(arg_min(forecast_date, ROW(predicted_revenue, rn)), '%Y-%m-%d') AS lowest_date, MIN(predicted_revenue) AS lowest_revenue
    FROM ranked GROUP BY user_id""", **RANKED))
def revenue_outlook(t):
    return day_text(insights.revenue_outlook(points(t)), "peak_date", "lowest_date")


def way(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'insufficient-data' WHEN {c} > 5 THEN 'increasing' WHEN {c} < -5 THEN 'decreasing' ELSE 'stable' END"


WEEK = {**RANKED, "weeks": """SELECT p.user_id, po, pr, ro, rr, rr / nullif(ro, 0) AS ra, CASE WHEN ro > 0 THEN pr / nullif(po, 0) END AS pa FROM (
    SELECT user_id, SUM(expected_orders) AS po, SUM(predicted_revenue) AS pr FROM ranked WHERE rn <= 7 GROUP BY user_id) p
    LEFT JOIN (SELECT user_id, SUM(orders) AS ro, SUM(revenue) AS rr FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS k FROM hist WHERE observed) WHERE k <= 7 GROUP BY user_id) h
    ON h.user_id = p.user_id""",
    "moves": """SELECT *, (po - ro) / nullif(abs(ro), 0) * 100 AS d, (pa - ra) / nullif(abs(ra), 0) * 100 AS a,
    (pr - rr) / nullif(abs(rr), 0) * 100 AS v FROM weeks"""}


@register("forecast_trends", point_rows(f"""SELECT user_id, {way('d')} AS demand_direction, {r('d')} AS demand_change, {way('a')} AS aov_direction,
    {r('a')} AS aov_change, {way('v')} AS revenue_direction, {r('v')} AS revenue_change, {money('ro')} AS recent_orders,
    {money('po')} AS projected_orders, {r('ra')} AS recent_aov, {r('pa')} AS projected_aov, {money('rr')} AS recent_revenue,
    {money('pr')} AS projected_revenue FROM moves""", **WEEK))
def forecast_trends(t):
    return insights.trends(points(t), history(t))


def _peaks_sql(last: str = "") -> str:
    return point_rows(f"""SELECT user_id, {ymd('forecast_date')}, predicted_revenue, {r('(predicted_revenue - m) / m * 100')} AS deviation_percent,
    row_number() OVER (PARTITION BY user_id ORDER BY predicted_revenue DESC, p.forecast_date) AS rank
    FROM (SELECT *, AVG(predicted_revenue) OVER (PARTITION BY user_id) AS m FROM points) p
    WHERE m > 0 AND predicted_revenue >= m * 1.25 {last}""")


@register("peak_days", _peaks_sql())
def peak_days(t):
    return day_text(insights.peak_days(points(t)), "forecast_date").withColumn("rank", F.col("rank").cast("long"))


@register("top_peak_days", _peaks_sql(
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY predicted_revenue DESC, p.forecast_date) <= 3"))
def top_peak_days(t):
    return peak_days(t).filter("rank <= 3")


@register("lowest_days", point_rows(f"""SELECT user_id, {ymd('forecast_date')}, predicted_revenue, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_revenue, rn) AS rank FROM ranked WHERE rn <= 7) q
    WHERE rank <= 2""", **RANKED))
def lowest_days(t):
    return day_text(insights.lowest_days(points(t)), "forecast_date").withColumn("rank", F.col("rank").cast("long"))


RISKS = risks(END)
ALL_NOTES = {**WEEK, **RISKS, **ADVICE, **EXPLAINED, **NOTES}


@register("risk_alerts", point_rows("SELECT * FROM risk", **RISKS))
def risk_alerts(t):
    return all_insights(t)[0]["risks"].withColumn("alert_no", F.col("alert_no").cast("long"))


@register("business_recommendations", point_rows("SELECT * FROM advice", **WEEK, **RISKS, **ADVICE))
def business_recommendations(t):
    rows = all_insights(t)[0]["recommendations"]
    return rows.withColumn("supporting_dates", F.array_join("supporting_dates", "|")).withColumn("place", F.col("place").cast("long"))


@register("forecast_explanations", point_rows("SELECT * EXCLUDE (day) FROM explained", **EXPLAINED))
def forecast_explanations(t):
    rows = explain.explain_days(points(t))
    text = F.array_join(F.transform("reasons", lambda x: F.concat_ws(" / ", x["type"], x["message"], x["impact"])), "|")
    return day_text(rows.withColumn("reasons", text), "date")


@register("first_explained_days", point_rows("""SELECT * EXCLUDE (day, reasons) FROM explained
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) <= 7""", **EXPLAINED))
def first_explained_days(t):
    return day_text(explain.first_days(explain.explain_days(points(t))), "date").drop("reasons")


def notification_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A first run that only stored risks, then a full run over it: (created, skipped)."""
    sections, pts = all_insights(t)
    batch = notify.candidates(sections["risks"], sections["recommendations"], explain.explain_days(pts))
    nothing = batch.filter("false")
    before, _ = notify.split_new(batch.filter("type = 'risk'"), nothing, "2001-07-30")
    return notify.split_new(batch, before, END)


@register("notifications_created", point_rows(f"""SELECT *, '{END}' AS created_at, row_number() OVER (PARTITION BY user_id
    ORDER BY type, title, related_date NULLS FIRST, related_metric) AS rank FROM fresh""", **ALL_NOTES))
def notifications_created(t):
    order = Window.partitionBy("user_id").orderBy("type", "title", F.asc_nulls_first("related_date"), "related_metric")
    ranked = notification_run(t)[0].withColumn("rank", F.row_number().over(order).cast("long"))
    return day_text(ranked, "related_date", "created_at")


@register("notification_list", point_rows(f"""SELECT *, '{END}' AS created_at, row_number() OVER (PARTITION BY user_id
    ORDER BY type, title, related_date NULLS FIRST, related_metric) AS rank FROM fresh QUALIFY rank <= 100""", **ALL_NOTES))
def notification_list(t):
    listed = day_text(notify.listing(notification_run(t)[0], 100), "related_date", "created_at")
    return listed.withColumn("rank", F.col("rank").cast("long"))


@register("notifications_skipped", point_rows("""SELECT user_id, type, title, related_metric, related_date, 1 AS times
    FROM notes WHERE type = 'risk'""", **ALL_NOTES))
def notifications_skipped(t):
    return day_text(notification_run(t)[1], "related_date")


@register("notification_counts", point_rows("""SELECT user_id, COUNT(*) AS notifications, COUNT(*) AS unread FROM fresh
    GROUP BY user_id""", **ALL_NOTES))
def notification_counts(t):
    return notify.unread_counts(notification_run(t)[0])

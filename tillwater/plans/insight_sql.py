"""Check SQL of explanations, risks, advice and notifications."""

from __future__ import annotations

from tillwater.plans.sql import r


def fixed2(x: str) -> str:
    return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(38,8)), 2) AS DECIMAL(18,2)) AS VARCHAR)"


def signed(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN '+' ELSE '' END || {fixed2(x)} || '%')"


def grouped(x: str) -> str:
    """Indian digit grouping of a positive number below 10^9."""
    s = f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(38,4)), 0) AS BIGINT) AS VARCHAR)"
    return f"""(CASE WHEN len({s}) <= 3 THEN {s} WHEN len({s}) <= 5 THEN left({s}, -3) || ',' || right({s}, 3)
      WHEN len({s}) <= 7 THEN left({s}, -5) || ',' || substr(right({s}, 5), 1, 2) || ',' || right({s}, 3)
      ELSE left({s}, -7) || ',' || substr(right({s}, 7), 1, 2) || ',' || substr(right({s}, 5), 1, 2) || ',' || right({s}, 3) END)"""


AVERAGE = "the forecast-period average."
EXPLAINED = {
    "means": """SELECT *, CAST(predicted_orders AS DOUBLE) AS o, AVG(predicted_revenue) OVER (PARTITION BY user_id) AS mr,
        AVG(CAST(predicted_orders AS DOUBLE)) OVER (PARTITION BY user_id) AS mo, AVG(predicted_aov) OVER (PARTITION BY user_id) AS ma FROM points""",
    "placed": f"""SELECT *, {r('(predicted_revenue - mr) / nullif(mr, 0) * 100')} AS deviation,
        CASE WHEN mr = 0 THEN 'unknown' WHEN (predicted_revenue - mr) / mr * 100 >= 10 THEN 'high'
          WHEN (predicted_revenue - mr) / mr * 100 <= -10 THEN 'low' ELSE 'normal' END AS position,
        mo > 0 AND o > mo * 1.1 AS more, mo > 0 AND o < mo * 0.9 AS fewer, ma > 0 AND predicted_aov > ma * 1.1 AS dear,
        ma > 0 AND predicted_aov < ma * 0.9 AS cheap FROM means""",
    "explained": f"""SELECT user_id, forecast_date AS day, strftime(forecast_date, '%Y-%m-%d') AS date, dayname(forecast_date) AS weekday, predicted_revenue,
        {r('o')} AS expected_orders, predicted_aov, position AS revenue_position, deviation AS deviation_percent,
        array_to_string(list_filter([
          CASE WHEN position = 'high' THEN 'revenue-above-average / Predicted revenue is ' || {signed('deviation')} || ' above {AVERAGE} / positive' END,
          CASE WHEN position = 'low' THEN 'revenue-below-average / Predicted revenue is ' || {signed('deviation')} || ' below {AVERAGE} / negative' END,
          CASE WHEN more THEN 'higher-demand / Expected orders are ' || {signed('(o - mo) / mo * 100')} || ' above {AVERAGE} / positive' END,
          CASE WHEN fewer THEN 'lower-demand / Expected orders are ' || {signed('(o - mo) / mo * 100')} || ' below {AVERAGE} / negative' END,
          CASE WHEN dear THEN 'higher-aov / Predicted AOV is ' || {signed('(predicted_aov - ma) / ma * 100')} || ' above {AVERAGE} / positive' END,
          CASE WHEN cheap THEN 'lower-aov / Predicted AOV is ' || {signed('(predicted_aov - ma) / ma * 100')} || ' below {AVERAGE} / negative' END],
          lambda x: x IS NOT NULL), '|') AS reasons,
        CASE WHEN position = 'high' AND more THEN 'Prepare inventory and operational capacity for potentially stronger demand.'
          WHEN position = 'high' AND dear THEN 'Consider maintaining premium-product availability and upselling capacity.'
          WHEN position = 'high' THEN 'Prepare inventory and promotional capacity for a potentially stronger revenue day.'
          WHEN position = 'low' AND fewer THEN 'Consider targeted promotions or customer-retention activity to support demand.'
          WHEN position = 'low' AND cheap THEN 'Consider bundles, upselling, and cross-selling to improve transaction value.'
          WHEN position = 'low' THEN 'Consider targeted promotions or retention activity around this lower-revenue day.'
          ELSE 'Monitor the day alongside the overall forecast and adjust operations according to actual demand.' END AS business_implication
        FROM placed""",
}


def risks(end: str) -> dict[str, str]:
    return {
        "cover": f"""SELECT user_id, CAST(ROUND(CAST(COUNT(DISTINCT CAST(order_date AS DATE)) /
            (date_diff('day', MIN(CAST(order_date AS DATE)), MAX(CAST(order_date AS DATE))) + 1) AS DECIMAL(38,10)), 4) AS DOUBLE) AS coverage
            FROM done WHERE order_date >= DATE '{end}' - 89 GROUP BY user_id""",
        "risk": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY no) AS alert_no, level, type, title, message FROM (
            SELECT s.user_id, unnest([
              {'no': 1, 'ok': m IS NULL, 'level': 'high', 'type': 'insufficient-forecast', 'title': 'Insufficient Forecast Data',
               'message': 'No forecast points are available for business analysis.'},
              {'no': 2, 'ok': m > 0 AND (hi - lo) / m >= 1.5, 'level': 'medium', 'type': 'revenue-volatility', 'title': 'Revenue Volatility',
               'message': 'Forecast revenue shows significant variation across the forecast period.'},
              {'no': 3, 'ok': m IS NOT NULL AND coverage < 0.8, 'level': 'medium', 'type': 'data-coverage', 'title': 'Limited Data Coverage',
               'message': 'Historical data coverage is limited. Forecast-based decisions should be made cautiously.'},
              {'no': 4, 'ok': m IS NOT NULL AND spike_days > 0, 'level': 'low', 'type': 'historical-spikes', 'title': 'Historical Revenue Spikes',
               'message': 'Recent historical data contains revenue spikes that may increase forecast uncertainty.'}], recursive := true)
            FROM (SELECT DISTINCT user_id FROM hist) s
            LEFT JOIN (SELECT user_id, AVG(predicted_revenue) AS m, MAX(predicted_revenue) AS hi, MIN(predicted_revenue) AS lo FROM points GROUP BY user_id) p
              ON p.user_id = s.user_id
            LEFT JOIN cover c ON c.user_id = s.user_id
            LEFT JOIN (SELECT user_id, spike_days FROM e5 WHERE adate IS NULL) e ON e.user_id = s.user_id) WHERE ok""",
    }


def adverse(c: str) -> str:
    return f"CASE WHEN abs({c}) > 20 THEN 'high' WHEN abs({c}) >= 10 THEN 'medium' ELSE 'low' END"


def entry(no: int, ok: str, priority: str, category: str, title: str, metric: str, change: str, text: str, dates: str) -> str:
    return (f"{{'no': {no}, 'ok': {ok}, 'priority': {priority}, 'category': '{category}', 'title': '{title}', 'metric': {metric},"
            f" 'change_percent': CAST({change} AS DOUBLE), 'recommendation': {text}, 'supporting_dates': {dates}}}")


def gain(c: str) -> str:
    return f"CASE WHEN {c} > 20 THEN 'high' ELSE 'medium' END"


ENTRIES = [
    entry(1, "vd = 'decreasing'", adverse("v"), "revenue-risk", "Revenue Decline Risk", "'revenue'", "v",
          f"'Forecast revenue is ' || {fixed2('abs(v)')} || '% below recent observed revenue. Review demand-generation and conversion strategies"
          " before the forecast period. Prioritize attention around ' || low_text || '.'", "low_dates"),
    entry(2, "vd = 'increasing'", gain("v"), "revenue-opportunity", "Revenue Growth Opportunity", "'revenue'", "v",
          f"'Forecast revenue is ' || {fixed2('v')} || '% above recent observed revenue. Prepare inventory, staffing, and operational capacity to"
          f" capitalize on the expected growth.' || (CASE WHEN peak_revenue <> 0 THEN ' The highest forecast day is ' || peak_date ||"
          f" ', with predicted revenue of ₹' || {grouped('peak_revenue')} || '.' ELSE '' END)", "peak_date"),
    entry(3, "dd = 'decreasing'", adverse("d"), "demand-risk", "Demand Decline Risk", "'orders'", "d",
          f"'Forecast order volume is ' || {fixed2('abs(d)')} || '% below recent observed demand. Consider targeted promotional and"
          " customer-retention campaigns, especially around ' || replace(low_dates, '|', ' and ') || '.'", "low_dates"),
    entry(4, "dd = 'increasing'", gain("d"), "demand-opportunity", "Demand Growth Opportunity", "'orders'", "d",
          f"'Forecast order volume is ' || {fixed2('d')} || '% above recent observed demand. Increase inventory readiness, staffing capacity, and"
          " operational preparation for the expected increase in demand.'", "''"),
    entry(5, "ad = 'decreasing'", adverse("a"), "aov-risk", "Average Order Value Risk", "'aov'", "a",
          f"'Forecast average order value is ' || {fixed2('abs(a)')} || '% below the recent observed AOV. Consider bundles, upselling, cross-selling,"
          " and premium-product recommendations to increase transaction value.'", "''"),
    entry(6, "ad = 'increasing'", gain("a"), "aov-opportunity", "Average Order Value Opportunity", "'aov'", "a",
          f"'Forecast average order value is ' || {fixed2('a')} || '% above recent observed AOV. Prioritize premium products, bundles, and"
          " higher-value customer segments to capitalize on the expected increase.'", "''"),
    entry(7, "top_date IS NOT NULL", "'high'", "peak-demand", "Forecast Peak-Day Opportunity", "'predictedRevenue'", "top_dev",
          f"'Prepare additional inventory, staffing, and marketing support for ' || top_date || ', which has forecast revenue of ₹' ||"
          f" {grouped('top_revenue')} || ', approximately ' || {fixed2('abs(top_dev)')} || '% above the forecast-period average.'", "top_dates"),
    entry(8, "high_risk", "'high'", "forecast-risk", "Forecast Reliability Risk", "NULL", "NULL",
          "'Use conservative planning because the current forecast contains a high-risk data or forecast-quality condition. Validate major business"
          " decisions against additional observed sales information.'", "''"),
    entry(9, "n7 > 0 AND n30 > 0", "'low'", "planning", "Forecast-Based Planning", "NULL", "NULL",
          "'Use the 7-day revenue outlook for short-term operational planning and the 30-day outlook for broader business planning.'", "''"),
]


def way(c: str) -> str:
    return f"CASE WHEN {c} > 5 THEN 'increasing' WHEN {c} < -5 THEN 'decreasing' ELSE 'stable' END"


ADVICE = {
    "facts": f"""SELECT m.user_id, {r('m.d')} AS d, {r('m.a')} AS a, {r('m.v')} AS v, {way('m.d')} AS dd, {way('m.a')} AS ad, {way('m.v')} AS vd,
        o.*, l.*, t.*, COALESCE(h.high_risk, false) AS high_risk FROM moves m
        JOIN (SELECT user_id AS u1, SUM(predicted_revenue) FILTER (rn <= 7) AS n7, SUM(predicted_revenue) FILTER (rn <= 30) AS n30,
          strftime(arg_max(forecast_date, ROW(predicted_revenue, -rn)), '%Y-%m-%d') AS peak_date, MAX(predicted_revenue) AS peak_revenue
          FROM ranked GROUP BY user_id) o ON o.u1 = m.user_id
        JOIN (SELECT user_id AS u2, string_agg(strftime(forecast_date, '%Y-%m-%d'), '|' ORDER BY k) AS low_dates,
          string_agg(strftime(forecast_date, '%Y-%m-%d') || ' (₹' || {grouped('predicted_revenue')} || ')', ' and ' ORDER BY k) AS low_text
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_revenue, rn) AS k FROM ranked WHERE rn <= 7) WHERE k <= 2
          GROUP BY user_id) l ON l.u2 = m.user_id
        LEFT JOIN (SELECT user_id AS u3, string_agg(strftime(forecast_date, '%Y-%m-%d'), '|' ORDER BY k) FILTER (k <= 3) AS top_dates,
          MAX(strftime(forecast_date, '%Y-%m-%d')) FILTER (k = 1) AS top_date, MAX(predicted_revenue) AS top_revenue,
          {r('MAX((predicted_revenue - m) / m * 100)')} AS top_dev
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY predicted_revenue DESC, forecast_date) AS k FROM (
            SELECT *, AVG(predicted_revenue) OVER (PARTITION BY user_id) AS m FROM points) WHERE m > 0 AND predicted_revenue >= m * 1.25)
          GROUP BY user_id) t ON t.u3 = m.user_id
        LEFT JOIN (SELECT user_id AS u4, bool_or(level = 'high') AS high_risk FROM risk GROUP BY user_id) h ON h.u4 = m.user_id""",
    "advice": f"""SELECT user_id, priority, category, title, metric, change_percent, recommendation, supporting_dates,
        row_number() OVER (PARTITION BY user_id ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, no) AS place
        FROM (SELECT user_id, unnest([{", ".join(ENTRIES)}], recursive := true) FROM facts) WHERE ok""",
}
NOTES = {
    "notes": f"""SELECT user_id, 'risk' AS type, level AS priority, title, message, CAST(NULL AS VARCHAR) AS related_date, type AS related_metric FROM risk
        UNION ALL SELECT user_id, CASE WHEN category = 'revenue-opportunity' THEN 'forecast' ELSE 'recommendation' END, priority, title, recommendation,
          nullif(split_part(supporting_dates, '|', 1), ''), metric FROM advice WHERE category <> 'planning'
        UNION ALL SELECT user_id, 'forecast', CASE WHEN revenue_position = 'high' THEN 'low' ELSE 'medium' END,
          CASE WHEN revenue_position = 'high' THEN 'Strong Forecast Day' ELSE 'Weak Forecast Day' END,
          date || ' is forecast at ?' || {grouped('predicted_revenue')} || ' revenue. ' || CASE WHEN revenue_position = 'high'
            THEN 'Expected orders: ' || {fixed2('expected_orders')} || ' and predicted AOV: ?' || {grouped('predicted_aov')} || '.'
            ELSE 'Consider targeted promotional or retention activity.' END, date, 'predictedRevenue'
          FROM explained WHERE revenue_position IN ('high', 'low')""",
    "fresh": """SELECT user_id, type, priority, title, message, false AS read, related_date, related_metric FROM notes WHERE type <> 'risk'""",
}

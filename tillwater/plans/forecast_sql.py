"""Check SQL of the forecast queries: the same model over lists and grouped rows."""

from __future__ import annotations

from itertools import count

from tillwater.plans.sql import r

_names = (f"x{n}" for n in count())


def mapped(a: str, body) -> str:
    v = next(_names)
    return f"list_transform({a}, lambda {v}: {body(v)})"


def kept(a: str, body) -> str:
    v = next(_names)
    return f"list_filter({a}, lambda {v}: {body(v)})"


def quant(a: str, q: float) -> str:
    return f"list_aggregate({a}, 'quantile_cont', {q})"


def clamp(x: str, low, high) -> str:
    return f"least(greatest({x}, {low}), {high})"


def winsor(a: str) -> str:
    lo, hi = quant(a, 0.05), quant(a, 0.90)
    return f"(CASE WHEN len({a}) >= 5 AND {hi} > {lo} THEN {mapped(a, lambda x: clamp(x, lo, hi))} ELSE {a} END)"


def wmean(a: str) -> str:
    v, i = next(_names), next(_names)
    return f"list_sum(list_transform({a}, lambda {v}, {i}: {v} * ({i} / (len({a}) * (len({a}) + 1) / 2.0))))"


def log_base(a: str) -> str:
    return f"greatest(0.0, exp({wmean(mapped(winsor(a), lambda x: f'ln(1 + {x})'))}) - 1)"


def cap(a: str) -> str:
    logs = mapped(a, lambda x: f"ln(1 + greatest({x}, 0))")
    m = f"list_median({logs})"
    mad = f"list_median({mapped(logs, lambda x: f'abs({x} - {m})')})"
    return f"(CASE WHEN {mad} > 1e-9 THEN {m} + 3 * (1.4826 * {mad}) ELSE CAST('inf' AS DOUBLE) END)"


def robust(a: str) -> str:
    m = f"list_median({a})"
    mad = f"list_median({mapped(a, lambda x: f'abs({x} - {m})')})"
    inner = mapped(a, lambda x: clamp(x, f"{m} - 3 * (1.4826 * {mad})", f"{m} + 3 * (1.4826 * {mad})"))
    return f"(CASE WHEN len({a}) >= 3 AND {mad} > 0 THEN {inner} ELSE {a} END)"


def slope(a: str) -> str:
    v, i = next(_names), next(_names)
    return (
        f"(CASE WHEN len({a}) >= 3 THEN list_sum(list_transform({a}, lambda {v}, {i}: ({i} - 1 - (len({a}) - 1) / 2.0) * {v}))"
        f" / (len({a}) * (len({a}) * len({a}) - 1) / 12.0) ELSE 0.0 END)"
    )


def avg(a: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN list_sum({a}) / len({a}) END)"


def nudge(l1: str, l7: str, roll: str, w: float, low: float, high: float) -> str:
    ref = f"list_avg(list_filter([{l1}, {l7}], lambda v: v IS NOT NULL))"
    return f"(CASE WHEN {roll} > 0 AND {ref} > 0 THEN {clamp(f'1 + {w} * ({ref} / {roll} - 1)', low, high)} ELSE 1.0 END)"


def trend(a: str) -> str:
    now, earlier = f"list_sum({a}[-7:])", f"list_sum({a}[-14:-8])"
    return f"(CASE WHEN len(rev) >= 14 AND {earlier} > 0 THEN {clamp(f'{now} / {earlier}', 0.6, 1.6)} ELSE 1.0 END)"


def back(a: str, n: int) -> str:
    return f"(CASE WHEN len({a}) >= {n} THEN {a}[-{n}] END)"


def model_ctes(horizon: int = 30, evaluation: int = 28, first: int = 5) -> dict[str, str]:
    """CTEs from ``hist`` to ``pred`` (one row per series, cutoff and target day)."""
    r_of, o_of = (lambda x: f"{x}.r"), (lambda x: f"{x}.o")
    keys = "user_id, known"
    group = lambda rows, value: (
        f"SELECT {keys}, wd, list(v ORDER BY k) AS vs FROM (SELECT {keys}, k, {rows}[k].wd AS wd, {value} AS v FROM ("
        f"SELECT {keys}, {rows}, unnest(range(1, len({rows}) + 1)) AS k FROM e3)) GROUP BY ALL"
    )
    return {
        "idx": """SELECT user_id, date, revenue, CAST(orders AS DOUBLE) AS orders, observed, isodow(date) - 1 AS wd,
            row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n,
            MAX(date) OVER (PARTITION BY user_id) AS last_date, bool_or(observed) OVER (PARTITION BY user_id) AS any_seen FROM hist""",
        "cut": f"""SELECT user_id, i AS known, date AS adate, revenue AS actual, orders AS aorders, last_date FROM idx
            WHERE any_seen AND n >= 5 AND observed AND i >= greatest({first}, n - {evaluation})
            UNION ALL SELECT DISTINCT user_id, n, NULL, NULL, NULL, last_date FROM idx WHERE any_seen AND n >= 5""",
        "tr": """SELECT c.user_id, c.known, any_value(c.adate) AS adate, any_value(c.actual) AS actual, any_value(c.aorders) AS aorders,
            any_value(c.last_date) AS last_date,
            list({'wd': d.wd, 'r': d.revenue, 'o': d.orders, 's': d.observed} ORDER BY d.i) AS t
            FROM cut c JOIN idx d ON d.user_id = c.user_id AND d.i < c.known GROUP BY c.user_id, c.known""",
        "e1": f"SELECT *, {kept('t', lambda x: f'{x}.s')} AS obs FROM tr",
        "e2": f"""SELECT *, len(t) AS nd, {mapped('obs', r_of)} AS rev, {mapped('obs', o_of)} AS ord,
            {kept('obs', lambda x: f'{x}.r > 0 AND {x}.o > 0')} AS sold,
            {mapped(kept('obs', lambda x: f'{x}.o > 0'), lambda x: f'{x}.r / {x}.o')} AS aovs FROM e1""",
        "e2b": f"""SELECT *, {cap('rev')} AS cap_rev, {cap('rev[-10:]')} AS cap10, {cap(mapped('sold[-30:]', r_of))} AS cap30,
            {cap(mapped('sold', lambda x: f'{x}.r / {x}.o'))} AS cap_aov FROM e2""",
        "e3": f"""SELECT *, {kept('sold[-30:]', lambda x: f'ln(1 + {x}.r) <= cap30')} AS calm,
            {kept('obs', lambda x: f'ln(1 + {x}.r) <= cap_rev')} AS nr, {kept('sold', lambda x: f'ln(1 + {x}.r / {x}.o) <= cap_aov')} AS na,
            CASE WHEN len(rev) >= 5 THEN len({kept('rev[-10:]', lambda x: f'ln(1 + {x}) > cap10')}) END AS spikes,
            len({kept('rev', lambda x: f'ln(1 + {x}) > cap_rev')}) AS spike_days FROM e2b""",
        "e4": f"""SELECT *, CASE WHEN len(sold) > 0 THEN (CASE WHEN len(calm) < 5 THEN
              greatest(1.0, list_sum({mapped('sold[-30:]', r_of)}) / list_sum({mapped('sold[-30:]', o_of)}))
              ELSE greatest(1.0, list_sum({mapped('calm', r_of)}) / list_sum({mapped('calm', o_of)})) END) END AS aov0,
            CASE WHEN len(ord) > 0 THEN greatest(0.0, {wmean(winsor('ord[-14:]'))}) END AS base0,
            {log_base(mapped('nr', r_of))} AS lb_rev, {log_base(mapped('na', lambda x: f'{x}.r / {x}.o'))} AS lb_aov,
            {back('rev', 1)} AS r1, {back('rev', 7)} AS r7, {avg('rev[-7:]')} AS rr, {back('ord', 1)} AS o1, {back('ord', 7)} AS o7,
            {avg('ord[-7:]')} AS oo, {back('aovs', 1)} AS a1, {back('aovs', 8)} AS a7,
            CASE WHEN len(aovs) >= 2 THEN {avg('aovs[-7:]')} END AS ar, {trend('rev')} AS rt, {trend('ord')} AS ot,
            CASE WHEN len(aovs) >= 4 THEN {avg('aovs[-7:]')} END AS ra, CASE WHEN len(aovs) >= 14 THEN {avg('aovs[-14:-8]')} END AS pa,
            CASE WHEN spikes IS NULL THEN 0.3 WHEN spikes >= 2 THEN 0.75 WHEN spikes = 1 THEN 0.35 ELSE 1.0 END AS damp FROM e3""",
        "e5": f"""SELECT *, COALESCE(aov0, {log_base('rev[-14:]')}, 0.0) AS aov, COALESCE(base0, 0.0) AS base,
            CASE WHEN pa > 0 THEN {clamp('ra / pa', 0.85, 1.20)} ELSE 1.0 END AS atr FROM e4
            WHERE adate IS NULL OR (aov0 IS NOT NULL AND base0 IS NOT NULL)""",
        "wk_rev": group("nr", "nr[k].r"),
        "wk_aov": group("na", "na[k].r / na[k].o"),
        "wk": f"""SELECT e.user_id, e.known, w.wd,
            CASE WHEN len(rev) >= 14 AND len(nr) >= 7 AND lb_rev > 0 AND len(a.vs) > 0
              THEN {clamp(f"1 + ({log_base('a.vs')} / lb_rev - 1) * (len(a.vs) / (len(a.vs) + 6.0))", 0.85, 1.15)} ELSE 1.0 END AS fo,
            CASE WHEN len(sold) >= 7 AND len(na) >= 7 AND lb_aov > 0 AND len(b.vs) >= 2 AND {log_base('b.vs')} > 0
              THEN {clamp(f"1 + 0.35 * ({log_base('b.vs')} / lb_aov - 1)", 0.90, 1.10)} ELSE 1.0 END AS fa
            FROM e5 e CROSS JOIN (SELECT unnest(range(0, 7)) AS wd) w
            LEFT JOIN wk_rev a ON a.user_id = e.user_id AND a.known = e.known AND a.wd = w.wd
            LEFT JOIN wk_aov b ON b.user_id = e.user_id AND b.known = e.known AND b.wd = w.wd""",
        "tg": f"""SELECT g.*, w.fo, w.fa FROM (SELECT *, isodow(date) - 1 AS wd FROM (
              SELECT *, adate AS date, 1 AS step FROM e5 WHERE adate IS NOT NULL
              UNION ALL SELECT * EXCLUDE (step), CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date, step FROM (
                SELECT *, unnest(range(1, {horizon} + 1)) AS step FROM e5 WHERE adate IS NULL))) g
            JOIN wk w ON w.user_id = g.user_id AND w.known = g.known AND w.wd = g.wd""",
        "p1": f"""SELECT *, round_even(least(greatest(0.0, base * fo), base * 1.25), 0) AS v4_orders, aov * fa AS v4_aov,
            base * greatest(0.0, 1 + damp * (ot - 1)) AS trended,
            least(greatest(1.0, (0.5 * greatest(aov, 1.0) + 0.3 * COALESCE(ra, greatest(aov, 1.0)) + 0.2 * COALESCE(pa, greatest(aov, 1.0)))
              * greatest(0.0, 1 + damp * (atr - 1)) * fa * {nudge('a1', 'a7', 'ar', 0.10, 0.97, 1.03)}), greatest(aov, 1.0) * 2.5) AS p0 FROM tg""",
        "p2": f"""SELECT *, least(greatest(0.0, trended * fo * {nudge('o1', 'o7', 'oo', 0.15, 0.95, 1.05)}), trended * 1.25) AS expected FROM p1""",
        "p3": """SELECT *, greatest(0.0, round_even(expected, 0)) AS k,
            list_filter([r1, r7, rr], lambda v: v IS NOT NULL AND v > 0) AS refs FROM p2""",
        "p4": f"""SELECT *, CASE WHEN k > 0 AND len(refs) > 0 AND list_avg(refs) * rt > 0
              THEN greatest(1.0, p0 * {clamp('1 + 0.12 * (list_avg(refs) * rt / k / p0 - 1)', 0.92, 1.08)}) ELSE p0 END AS p1,
            damp = 0.75 AND (COALESCE(ra >= aov * 1.15 AND atr >= 1.10, false) OR ot >= 1.10
              OR (CASE WHEN base > 0 THEN k / base ELSE 1.0 END) >= 1.05) AS regime FROM p3""",
        "pred": """SELECT *, CASE WHEN k > 0 THEN greatest(1.0, p1 * (CASE WHEN regime THEN 1.0 ELSE 0.85 END)) ELSE p1 END AS paov,
            k * (CASE WHEN k > 0 THEN greatest(1.0, p1 * (CASE WHEN regime THEN 1.0 ELSE 0.85 END)) ELSE p1 END) AS revenue,
            v4_orders * v4_aov AS v4_revenue FROM p4""",
    }


def points_ctes() -> dict[str, str]:
    """CTE ``points``: rounded future days with intervals."""
    return {
        "resid": """SELECT e.user_id, COUNT(*) AS m, stddev_samp(x.r - x.o * e.aov * w.fa) AS sd, any_value(e.aov) AS aov FROM (
              SELECT user_id, known, aov, cap_rev, unnest(t) AS x FROM e5 WHERE adate IS NULL) e
            JOIN wk w ON w.user_id = e.user_id AND w.known = e.known AND w.wd = e.x.wd
            WHERE NOT (e.x.s AND ln(1 + e.x.r) > e.cap_rev) GROUP BY e.user_id""",
        "sds": """SELECT user_id, greatest(CASE WHEN m >= 2 THEN sd ELSE greatest(0.25 * aov, 1.0) END, 0.1 * aov, 1.0) AS sd FROM resid""",
        "points": f"""SELECT p.user_id, p.date AS forecast_date, {r('revenue')} AS predicted_revenue, CAST(k AS BIGINT) AS predicted_orders,
            {r('expected', 4)} AS expected_orders, {r('paov')} AS predicted_aov,
            {r('greatest(0.0, revenue - 1.96 * sd * (1 + 0.05 * (step - 1)))')} AS lower_bound,
            {r('revenue + 1.96 * sd * (1 + 0.05 * (step - 1))')} AS upper_bound,
            {r('v4_revenue')} AS v4_revenue, CAST(v4_orders AS BIGINT) AS v4_orders, {r('v4_aov')} AS v4_aov
            FROM pred p JOIN sds s ON s.user_id = p.user_id WHERE adate IS NULL""",
    }


LEGACY = {
    "g1": f"SELECT *, {robust('rev[-14:]')} AS clipped, {avg(robust('rev'))} AS gmean, len(rev) / nd AS rate FROM lg",
    "g_wk": """SELECT user_id, known, list(v ORDER BY k) AS vs FROM (SELECT user_id, known, wd, k, obs[k].wd AS dwd, obs[k].r AS v FROM (
        SELECT user_id, known, wd, obs, unnest(range(1, len(obs) + 1)) AS k FROM lg)) WHERE dwd = wd GROUP BY ALL""",
    "g2": f"""SELECT g.*, greatest(0.0, {wmean('clipped')}) AS selling,
        CASE WHEN len(rev) >= 14 AND gmean > 0 AND len(w.vs) >= 2 AND {avg(robust('w.vs'))} > 0
          THEN {clamp(f"1 + ({avg(robust('w.vs'))} / gmean - 1) * least(1.0, len(w.vs) / 6.0)", 0.75, 1.25)} ELSE 1.0 END AS f
        FROM g1 g LEFT JOIN g_wk w ON w.user_id = g.user_id AND w.known = g.known""",
    "g3": f"""SELECT *, selling * rate AS b, CASE WHEN len(rev[-14:]) >= 5 AND {avg('rev[-14:]')} > 0
          THEN list_aggregate(rev[-14:], 'stddev_samp') / {avg('rev[-14:]')} END AS cv, {slope('clipped')} AS raw_slope FROM g2""",
    "g4": """SELECT *, least(greatest(raw_slope, -greatest(b * 0.03, 1.0)), greatest(b * 0.03, 1.0))
          * (CASE WHEN cv > 1 THEN 0.25 WHEN cv > 0.75 THEN 0.5 ELSE 1.0 END)
          * (CASE WHEN len(rev) < 7 THEN 0.0 WHEN len(rev) < 14 OR rate < 0.5 THEN 0.2 WHEN len(rev) < 30 THEN 0.5 ELSE 1.0 END) AS slope,
        greatest(b * 0.10, selling * greatest(0.10, 1 - rate), 1.0) AS min_error FROM g3""",
    "legacy": """SELECT user_id, known, least(greatest(greatest(0.0, b + slope) * f, 0.5 * b * f), greatest(1.5 * b * f, b * f + min_error)) AS baseline
        FROM g4""",
}


def backtest_ctes() -> dict[str, str]:
    """CTE ``bt``: actual and three predictions per scored day; ``metrics`` per series."""
    return {
        "lg": "SELECT user_id, known, rev, obs, nd, wd FROM pred WHERE adate IS NOT NULL",
        **LEGACY,
        "bt": """SELECT p.user_id, p.date, p.actual, p.aorders AS orders, p.v4_revenue AS v4, p.revenue AS v4_1,
            COALESCE(l.baseline, 0.0) AS baseline FROM pred p LEFT JOIN legacy l ON l.user_id = p.user_id AND l.known = p.known
            WHERE p.adate IS NOT NULL""",
        "metrics": """SELECT user_id, COUNT(*) AS evaluation_days, AVG(abs(actual - v4_1)) AS mae, sqrt(AVG((actual - v4_1) ** 2)) AS rmse,
            AVG(CASE WHEN abs(actual) > 1e-9 THEN abs(actual - v4_1) / abs(actual) END) * 100 AS mape,
            SUM(abs(actual - v4_1)) / nullif(SUM(abs(actual)), 0) * 100 AS wape,
            AVG(CASE WHEN abs(actual) + abs(v4_1) > 1e-9 THEN abs(actual - v4_1) / (abs(actual) + abs(v4_1)) END) * 200 AS smape,
            SUM(abs(actual - baseline)) / nullif(SUM(abs(actual)), 0) * 100 AS baseline_wape,
            SUM(abs(actual - v4)) / nullif(SUM(abs(actual)), 0) * 100 AS v4_wape FROM bt GROUP BY user_id""",
    }

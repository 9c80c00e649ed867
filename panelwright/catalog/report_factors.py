"""Behaviour, event and report factors against SQL."""

from __future__ import annotations

from panelwright.catalog import fixtures as X
from panelwright.catalog.named import factor

C = X.Catalog()
PR = "pr AS (SELECT *, close / lag(close) OVER v - 1 AS ret, open / lag(close) OVER v - 1 AS overnight, close / open - 1 AS intraday FROM bars WINDOW v AS (PARTITION BY code ORDER BY date))\n"
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"
LADDER = "ladder AS (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1)\nSELECT b.code, b.date, l.value FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.notice"


def add(name, body, **k):
    C.add(f"FA_{name}", factor(name), body, **k)


_T = [f"CASE WHEN count({r}) OVER (w ROWS 19 PRECEDING) >= 20 AND stddev_samp({r}) OVER (w ROWS 19 PRECEDING) >= CASE WHEN count({r}) OVER (w ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) >= 20 THEN stddev_samp({r}) OVER (w ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) END THEN -sum({r}) OVER (w ROWS 19 PRECEDING) WHEN count({r}) OVER (w ROWS 19 PRECEDING) >= 20 THEN sum({r}) OVER (w ROWS 19 PRECEDING) END" for r in ("ret", "overnight", "intraday")]
add("12_team_coin_20", PR + f", x AS (SELECT code, date, ({' + '.join(_T)}) / 3 AS value FROM pr {W}) SELECT code, date, value FROM x", digits=3)
add("13_climb_peak_20", PR + f""", y AS (SELECT code, date, ret, ln(high / low) ** 2 / (4 * ln(2)) AS x FROM pr),
k AS (SELECT code, date, list(CASE WHEN ret IS NOT NULL THEN {{'r': ret, 'x': x}} END) OVER (w ROWS 19 PRECEDING) AS l, avg(x) OVER (w ROWS 19 PRECEDING) + stddev_samp(x) OVER (w ROWS 19 PRECEDING) AS b FROM y {W}),
f AS (SELECT code, date, list_filter(l, lambda e: e IS NOT NULL AND e.x >= b) AS l FROM k),
g AS (SELECT code, date, len(l) AS n, list_sum(list_transform(l, lambda e: e.r * e.x)) AS rx, list_sum(list_transform(l, lambda e: e.r)) AS r, list_sum(list_transform(l, lambda e: e.x)) AS x FROM f)
SELECT code, date, CASE WHEN n >= 3 THEN (rx - r * x / n) / (n - 1) END AS value FROM g""", digits=3)
_J = PR + f""", sd AS (SELECT *, CASE WHEN count(overnight) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 20 THEN stddev_samp(overnight) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS sd FROM pr {W}),
j AS (SELECT *, CASE WHEN sd IS NOT NULL THEN CAST(abs(overnight) > 2 * sd AS INTEGER) END AS j FROM sd)
"""
add("15_amp_nonjump_20", _J + f", x AS (SELECT code, date, CASE WHEN count(CASE WHEN j = 0 THEN 1 END) OVER (w ROWS 19 PRECEDING) >= 5 THEN avg(CASE WHEN j = 0 THEN (high - low) / close END) OVER (w ROWS 19 PRECEDING) END AS value FROM j {W}) SELECT code, date, value FROM x")
add("15_jump_share_20", _J + f", x AS (SELECT code, date, CASE WHEN count(j) OVER (w ROWS 19 PRECEDING) >= 10 THEN avg(j) OVER (w ROWS 19 PRECEDING) END AS value FROM j {W}) SELECT code, date, value FROM x")
add("16_boat_follow_20", f"""a AS (SELECT code, date, ln(amount) - ln(lag(amount) OVER w) AS a FROM bars {W}), m AS (SELECT *, avg(a) OVER (PARTITION BY date) AS m FROM a), n AS (SELECT code, date, a, CASE WHEN a IS NOT NULL THEN m END AS m FROM m),
x AS (SELECT code, date, CASE WHEN count(a) OVER (w ROWS 19 PRECEDING) >= 15 THEN covar_pop(a, m) OVER (w ROWS 19 PRECEDING) / (stddev_samp(a) OVER (w ROWS 19 PRECEDING) * stddev_samp(m) OVER (w ROWS 19 PRECEDING)) END AS value FROM n {W}) SELECT code, date, value FROM x""")
for _n, _h, _q, _op in (("19_high_volume_20", True, 0.8, ">="), ("19_low_volume_20", False, 0.2, "<=")):
    add(_n, f"""q AS (SELECT code, date, vol, close, CASE WHEN count(vol) OVER (w ROWS 59 PRECEDING) >= 45 THEN quantile_cont(vol, 0.8) OVER (w ROWS 59 PRECEDING) END AS v, CASE WHEN count(close) OVER (w ROWS 59 PRECEDING) >= 45 THEN quantile_cont(close, {_q}) OVER (w ROWS 59 PRECEDING) END AS c FROM bars {W}),
f AS (SELECT code, date, CASE WHEN v IS NOT NULL THEN CAST(vol >= v AND close {_op} c AS INTEGER) END AS f FROM q), x AS (SELECT code, date, CASE WHEN count(f) OVER (w ROWS 19 PRECEDING) >= 10 THEN sum(f) OVER (w ROWS 19 PRECEDING) END AS value FROM f {W}) SELECT code, date, value FROM x""")
add("21_cost_bias", """o AS (SELECT code, date, close AS p, CASE WHEN row_number() OVER v = 1 THEN 1.0 ELSE least(vol / 2000, 1) END AS u, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
r AS (SELECT code, date, p, p AS c, i FROM o WHERE i = 1 UNION ALL SELECT o.code, o.date, o.p, r.c * (1 - o.u) + o.p * o.u, o.i FROM r JOIN o ON o.code = r.code AND o.i = r.i + 1)
SELECT code, date, p / c - 1 AS value FROM r""")
C.oracle["FA_21_cost_bias"] = C.oracle["FA_21_cost_bias"].replace("WITH ", "WITH RECURSIVE ", 1)
for _n, _k in (("22_report_change", 1), ("22_report_change_2", 2)):
    add(_n, f"pc AS (SELECT c.code, c.period, c.notice, c.revenue, p.revenue AS v, row_number() OVER (PARTITION BY c.code, c.period ORDER BY p.period DESC) AS k FROM reports c JOIN reports p ON p.code = c.code AND p.period < c.period AND p.notice <= c.notice),\nc AS (SELECT r.code, r.period, r.notice, r.revenue / pc.v - 1 AS value FROM reports r LEFT JOIN pc ON pc.code = r.code AND pc.period = r.period AND pc.k = {_k}),\n" + LADDER.format(t="c").replace("SELECT b.code, b.date, l.value", "SELECT b.code, b.date, CASE WHEN date_diff('day', l.notice, b.date) <= 180 THEN l.value END AS value"))
add("23_event_sum_20", f"""e AS (SELECT b.code, b.date, b.amount, coalesce(sum(a.cash), 0) AS e FROM bars b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date - 19 AND b.date GROUP BY 1, 2, 3),
x AS (SELECT code, date, e / avg(amount) OVER (w ROWS 11 PRECEDING) AS value FROM e {W}) SELECT code, date, value FROM x""")
add("24_pressure_60", f"""e AS (SELECT b.code, b.date, b.amount, coalesce(sum(a.cash), 0) AS e FROM bars b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date AND b.date + 60 GROUP BY 1, 2, 3),
x AS (SELECT code, date, e / avg(amount) OVER (w ROWS 11 PRECEDING) AS value FROM e {W}) SELECT code, date, value FROM x""")
add("26_margin", "c AS (SELECT *, net_profit / nullif(revenue, 0) AS value FROM reports),\n" + LADDER.format(t="c"))
add("28_revenue_growth", "c AS (SELECT a.*, (a.revenue - b.revenue) / abs(b.revenue) AS value FROM reports a JOIN reports b ON a.code = b.code AND a.period = last_day(b.period + INTERVAL 12 MONTH)),\n" + LADDER.format(t="c"))
add("33_surprise", """q AS (SELECT *, year(period) * 4 + quarter(period) AS q FROM reports), c AS (SELECT a.code, a.period, a.q, greatest(a.notice, b.notice) AS n, a.revenue - b.revenue AS d FROM q a JOIN q b ON a.code = b.code AND a.q = b.q + 4),
k AS (SELECT *, avg(d) OVER w AS m, count(d) OVER w AS c, greatest(n, coalesce(max(n) OVER r, n)) AS known FROM c WINDOW w AS (PARTITION BY code ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY code ORDER BY q RANGE BETWEEN 16 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, d - m AS e FROM k WHERE c >= 4),
s AS (SELECT *, CASE WHEN count(e) OVER w >= 4 THEN stddev_samp(e) OVER w END AS s FROM e WINDOW w AS (PARTITION BY code ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)),
z AS (SELECT code, period, known, least(greatest(e / s, -10), 10) AS value FROM s WHERE s <> 0),
ladder AS (SELECT * FROM z WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, known ORDER BY period DESC) = 1)
SELECT b.code, b.date, l.value FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.known""")
_SHARES = "bf AS (SELECT b.code, b.date, b.close, c.float_shares FROM bars b ASOF LEFT JOIN capital c ON b.code = c.code AND b.date >= c.date)\n"
add("24_lockup_pressure_60", _SHARES + "SELECT b.code, b.date, coalesce(sum(a.cash), 0) / nullif(any_value(b.float_shares), 0) AS value FROM bf b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date AND b.date + 60 GROUP BY 1, 2", digits=6)
add("23_dragon_net_20", _SHARES + "SELECT b.code, b.date, coalesce(sum(s.net), 0) / nullif(any_value(b.float_shares * b.close), 0) AS value FROM bf b LEFT JOIN seats s ON s.code = b.code AND s.date BETWEEN b.date - 20 AND b.date - 1 GROUP BY 1, 2", digits=6)
add("23_block_premium_20", """k AS (SELECT t.code, t.date, t.amount, t.amount * (t.price / b.close - 1) AS w FROM blocks t ASOF JOIN bars b ON b.code = t.code AND t.date > b.date WHERE b.close > 0)
SELECT b.code, b.date, coalesce(sum(k.w) / nullif(sum(k.amount), 0), 0) AS value FROM bars b LEFT JOIN k ON k.code = b.code AND k.date BETWEEN b.date - 20 AND b.date - 1 GROUP BY 1, 2""")

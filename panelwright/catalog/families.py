"""The remaining members of the named factor families, each with its SQL."""

from __future__ import annotations

from panelwright.catalog import fixtures as X
from panelwright.catalog.named import factor

C = X.Catalog()
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"

# The panel: bars with flows, shares as of the date, returns, turnover and the market's mean return.
PX = """pf AS (SELECT b.code, b.date, b.open, b.high, b.low, b.close, b.vol, b.amount, f.main_net, g.small_net, g.net_amount, b.close / lag(b.close) OVER v - 1 AS ret FROM bars b JOIN flow f ON f.code = b.code AND f.date = b.date JOIN flows g ON g.code = b.code AND g.date = b.date WINDOW v AS (PARTITION BY b.code ORDER BY b.date)),
pc AS (SELECT pf.*, c.float_shares, c.total_shares FROM pf ASOF LEFT JOIN capital c ON pf.code = c.code AND pf.date >= c.date),
px AS (SELECT *, vol * 100 / float_shares AS turnover, avg(ret) OVER (PARTITION BY date) AS mkt FROM pc)
"""


def put(name: str, body: str, **k) -> None:
    """A factor of the panel, and its SQL over px."""
    C.add(f"FA_{name}", factor(name), PX + body, **k)


def over(fn: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) >= {least} THEN {fn}({x}) OVER (w ROWS {n - 1} PRECEDING) END"


def plain(name: str, expression: str, **k) -> None:
    put(name, f", x AS (SELECT code, date, {expression} AS value FROM px {W}) SELECT code, date, value FROM x", **k)


plain("01_momentum_60", "close / lag(close, 60) OVER w - 1")
plain("01_momentum_120", "close / lag(close, 120) OVER w - 1")
plain("01_reversal_10", "-(close / lag(close, 10) OVER w - 1)")
plain("02_volatility_60", over("stddev_samp", "ret", 60, 2))
plain("04_price_position_250", "close / max(close) OVER (w ROWS 249 PRECEDING)")
put("05_skewness_20", f""", st AS (SELECT code, date, ret, avg(ret) OVER (w ROWS 19 PRECEDING) AS m, stddev_samp(ret) OVER (w ROWS 19 PRECEDING) AS s, min(ret) OVER (w ROWS 19 PRECEDING) < max(ret) OVER (w ROWS 19 PRECEDING) AS varies FROM px {W}),
z AS (SELECT code, date, ((ret - m) / s) ** 3 AS z FROM st WHERE varies), x AS (SELECT code, date, avg(z) OVER (w ROWS 19 PRECEDING) AS value FROM z {W}) SELECT code, date, value FROM x""", digits=3)  # fmt: skip
plain("06_total_mcap", "ln(close * total_shares / 1e8)")
plain("06_turnover", "turnover")
plain("09_turnover_std_20", f"({over('stddev_samp', 'turnover', 20, 10)}) / ({over('avg', 'turnover', 20, 10)})")
plain("09_avg_amount_20", over("avg", "amount", 20, 1))
for _n, _x in (("small", "small_net"), ("net", "net_amount")):
    plain(f"10_{_n}_share_20", f"({over('sum', _x, 20, 15)}) / ({over('sum', 'amount', 20, 15)})")
put("10_smart_dumb_20", f", y AS (SELECT *, main_net - small_net AS d FROM px), x AS (SELECT code, date, ({over('sum', 'd', 20, 15)}) / ({over('sum', 'amount', 20, 15)}) AS value FROM y {W}) SELECT code, date, value FROM x")
_ANCHOR = "CASE WHEN close / lag(close, 10) OVER w - 1 > 0 THEN close / min(close) OVER (w ROWS 59 PRECEDING) - 1 ELSE close / max(close) OVER (w ROWS 59 PRECEDING) - 1 END"


plain("17_anchor_reversal_60", _ANCHOR)
plain("17_anchor_rev_vol", f"({_ANCHOR}) * ({over('stddev_samp', 'ret', 20, 2)})")
put("20_turn_idio_20", f", y AS (SELECT *, turnover - quantile_cont(turnover, 0.5) OVER (PARTITION BY date) AS i FROM px), x AS (SELECT code, date, {over('avg', 'i', 20, 15)} AS value FROM y {W}) SELECT code, date, value FROM x")

# Factors of bars and the main flow alone
PR = """pr AS (SELECT bars.*, main_net, close / lag(close) OVER v - 1 AS ret, open / lag(close) OVER v - 1 AS overnight FROM bars JOIN flow USING (code, date) WINDOW v AS (PARTITION BY code ORDER BY date)),
"""

def short(name: str, expression: str) -> None:
    C.add(f"FA_{name}", factor(name), PR + f"x AS (SELECT code, date, {expression} AS value FROM pr {W}) SELECT code, date, value FROM x")


short("01_momentum_20", "close / lag(close, 20) OVER w - 1")
short("01_reversal_5", "-(close / lag(close, 5) OVER w - 1)")
short("02_volatility_20", over("stddev_samp", "ret", 20, 2))
short("04_amplitude_20", "avg((high - low) / close) OVER (w ROWS 19 PRECEDING)")
short("04_max_return_20", "max(ret) OVER (w ROWS 19 PRECEDING)")
short("04_price_position_50", "close / max(close) OVER (w ROWS 49 PRECEDING)")
short("05_downside_20", "CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 10 THEN sqrt(avg(least(ret, 0) ** 2) OVER (w ROWS 19 PRECEDING)) END")
short("06_size", "ln(close * 1000)")
short("09_amihud_20", "CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) >= 10 THEN avg(abs(ret) / (amount / 1e6)) OVER (w ROWS 19 PRECEDING) END")
short("09_amount_cv_20", f"({over('stddev_samp', 'amount', 20, 10)}) / ({over('avg', 'amount', 20, 10)})")
short("10_flow_share_20", f"({over('sum', 'main_net', 20, 15)}) / ({over('sum', 'amount', 20, 15)})")
short("11_flow_change", f"({over('sum', 'main_net', 5, 5)}) / ({over('sum', 'amount', 5, 5)}) - ({over('sum', 'main_net', 20, 15)}) / ({over('sum', 'amount', 20, 15)})")
short("14_range_cv_20", "CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 15 THEN stddev_samp(0.5 * ln(high / low) ** 2) OVER (w ROWS 19 PRECEDING) / nullif(avg(0.5 * ln(high / low) ** 2) OVER (w ROWS 19 PRECEDING), 0) END")
short("17_anchor_30", "CASE WHEN close / lag(close, 10) OVER w - 1 > 0 THEN close / min(close) OVER (w ROWS 29 PRECEDING) - 1 ELSE close / max(close) OVER (w ROWS 29 PRECEDING) - 1 END")
short("18_overnight_20", "CASE WHEN count(CASE WHEN high > low THEN overnight END) OVER (w ROWS 19 PRECEDING) >= 8 THEN avg(CASE WHEN high > low THEN overnight END) OVER (w ROWS 19 PRECEDING) END")
short("33_clipped_z", "CASE WHEN count(amount) OVER (w ROWS 19 PRECEDING) >= 10 AND min(amount) OVER (w ROWS 19 PRECEDING) < max(amount) OVER (w ROWS 19 PRECEDING) THEN least(greatest((amount - avg(amount) OVER (w ROWS 19 PRECEDING)) / stddev_samp(amount) OVER (w ROWS 19 PRECEDING), -2), 2) END")
short("43_kyle_lambda_24", "CASE WHEN count(ret) OVER (w ROWS 23 PRECEDING) >= 12 AND min(CASE WHEN ret IS NOT NULL THEN vol END) OVER (w ROWS 23 PRECEDING) < max(CASE WHEN ret IS NOT NULL THEN vol END) OVER (w ROWS 23 PRECEDING) THEN regr_slope(ret, vol) OVER (w ROWS 23 PRECEDING) END")
C.add("FA_03_rsi_14", factor("03_rsi_14"), PR + """g AS (SELECT code, date, coalesce(greatest(close - lag(close) OVER w, 0), 0) AS g, coalesce(greatest(lag(close) OVER w - close, 0), 0) AS l FROM pr WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, CASE WHEN avg(l) OVER w = 0 THEN 100 ELSE 100 - 100 / (1 + avg(g) OVER w / avg(l) OVER w) END AS value FROM g WINDOW w AS (PARTITION BY code ORDER BY date ROWS 13 PRECEDING)""")

put("21_chip_vwap_bias_250", f""", h AS (SELECT code, date, close, list({{'p': close, 'u': least(turnover / 100, 1)}}) OVER (w ROWS 249 PRECEDING) AS h FROM px {W})
SELECT code, date, close / list_reduce(h, lambda a, x: {{'p': a.p * (1 - x.u) + x.p * x.u, 'u': 0.0::DOUBLE}}).p - 1 AS value FROM h""")

# Approximations from daily bars: illiquidity by path and side, tails, similarity to the market. Amounts in millions.
_KPATH = "least(abs(high - open) + abs(high - low) + abs(close - low), abs(open - low) + abs(high - low) + abs(close - high)) / close / (amount / 1e6)"


plain("43_cvar_20", over("avg", "CASE WHEN ret < 0 THEN ret END", 20, 10))
plain("43_kpath_illiq_20", over("avg", _KPATH, 20, 10))
plain("43_idio_illiq_20", over("avg", "abs(ret - mkt) / (amount / 1e6)", 20, 10))
put("43_kyle_lambda_60", f""", y AS (SELECT *, CASE WHEN ret IS NOT NULL THEN sign(ret) * amount / 1e6 END AS a FROM px),
x AS (SELECT code, date, CASE WHEN count(ret) OVER (w ROWS 59 PRECEDING) >= 30 AND min(a) OVER (w ROWS 59 PRECEDING) < max(a) OVER (w ROWS 59 PRECEDING) THEN regr_slope(ret, a) OVER (w ROWS 59 PRECEDING) END AS value FROM y {W}) SELECT code, date, value FROM x""", digits=3)  # fmt: skip
put("43_tsim_path_20", f""", y AS (SELECT *, ret - mkt AS e, CASE WHEN ret IS NOT NULL THEN mkt END AS k FROM px),
x AS (SELECT code, date, CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) >= 10 AND min(ret) OVER (w ROWS 19 PRECEDING) < max(ret) OVER (w ROWS 19 PRECEDING) THEN corr(ret, k) OVER (w ROWS 19 PRECEDING) - abs(sum(e) OVER (w ROWS 19 PRECEDING)) END AS value FROM y {W}) SELECT code, date, value FROM x""", digits=3)  # fmt: skip
for _n, _op in (("dn", "<"), ("up", ">")):
    plain(f"43_semi_illiq_{_n}_20", over("avg", f"CASE WHEN ret {_op} 0 THEN abs(ret) / (amount / 1e6) END", 20, 10))
plain("43_amp_downpos_20", over("avg", "CASE WHEN high > low THEN (high - close) / (high - low) END", 20, 10))
plain("43_repair_eff_20", f"CASE WHEN ({over('max', 'high', 20, 10)}) > ({over('min', 'low', 20, 10)}) THEN (close - min(low) OVER (w ROWS 19 PRECEDING)) / (max(high) OVER (w ROWS 19 PRECEDING) - min(low) OVER (w ROWS 19 PRECEDING)) END")
put("43_mf_sens_60", f""", y AS (SELECT *, CASE WHEN ret IS NOT NULL THEN main_net / amount END AS a FROM px),
x AS (SELECT code, date, CASE WHEN count(ret) OVER (w ROWS 59 PRECEDING) >= 30 AND min(a) OVER (w ROWS 59 PRECEDING) < max(a) OVER (w ROWS 59 PRECEDING) THEN regr_slope(ret, a) OVER (w ROWS 59 PRECEDING) END AS value FROM y {W}) SELECT code, date, value FROM x""", digits=3)  # fmt: skip

# Seats: what a kind of seat bought net over 20 calendar days, in ten-thousandths of 20 rows' amount.
for _n, _seat in (("inst", "F"), ("retail", "O")):
    C.add(f"FA_25_{_n}_buy_20", factor(f"25_{_n}_buy_20"), f"""e AS (SELECT b.code, b.date, b.amount, coalesce(sum(s.net), 0) AS e FROM bars b LEFT JOIN seats s ON s.code = b.code AND s.seat = '{_seat}' AND s.date BETWEEN b.date - 19 AND b.date GROUP BY 1, 2, 3),
x AS (SELECT code, date, e * 10000 / sum(amount) OVER (w ROWS 19 PRECEDING) AS value FROM e {W}) SELECT code, date, value FROM x""", digits=3)  # fmt: skip

# Ratios of the latest published statement.
LADDER = """, kept AS (SELECT * FROM (SELECT *, min(notice) OVER (PARTITION BY code ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM {t}) WHERE later IS NULL OR later > notice),
ladder AS (SELECT * FROM (SELECT code, notice AS known, {v} AS value, row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) AS k FROM kept) WHERE k = 1 AND value IS NOT NULL)
"""
ON_BARS = "SELECT b.code, b.date, l.value FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.known"
ITEMS = "i0 AS (SELECT * FROM items)"


def statement(name: str, expression: str, sql: str = ITEMS, t: str = "i0", **k) -> None:
    C.add(f"FA_{name}", factor(name), sql + LADDER.format(t=t, v=expression) + ON_BARS, **k)


for _n, _a, _b in (("26_roa", "net_profit", "total_assets"), ("26_net_margin", "net_profit", "revenue"), ("26_asset_turnover", "revenue", "total_assets"), ("26_roe", "net_profit", "total_equity"), ("26_debt_ratio", "total_liab", "total_assets"), ("26_ocf_ratio", "operate_cf", "net_profit"), ("27_op_margin", "op_profit", "revenue"), ("27_goodwill_ratio", "goodwill", "total_equity")):
    statement(_n, f"{_a} / nullif({_b}, 0)")
statement("26_current_ratio", "current_ratio")
statement("26_quick_ratio", "current_ratio - inventory / nullif(total_liab, 0)")
statement("27_accruals", "(net_profit - operate_cf) / nullif(total_assets, 0)")

# Trailing sums and growth over a year.
TTM = ("revenue", "net_profit", "operate_cf", "gross_profit", "one_off")
YEAR = ("revenue", "net_profit", "total_assets")
TTM_SQL = "i1 AS (SELECT *, " + ", ".join(f"CASE WHEN count({x}) OVER v = 4 THEN sum({x}) OVER v END AS {x}_ttm" for x in TTM) + " FROM items WINDOW v AS (PARTITION BY code ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),\ni2 AS (SELECT i1.*, " + ", ".join(f"b.{x} AS {x}_y" for x in YEAR) + " FROM i1 LEFT JOIN items b ON b.code = i1.code AND b.q = i1.q - 4)"


def trailing(name: str, expression: str, **k) -> None:
    statement(name, expression, TTM_SQL, "i2", **k)


for _n, _x in (("28_profit_growth_yoy", "net_profit"), ("28_asset_growth_yoy", "total_assets"), ("29_np_q_yoy", "net_profit"), ("29_rev_q_yoy", "revenue")):
    trailing(_n, f"({_x} - {_x}_y) / nullif(abs({_x}_y), 0)")
trailing("29_roe_ttm", "net_profit_ttm / nullif(total_equity, 0)")
trailing("29_roe_cut", "(net_profit_ttm - one_off_ttm) / nullif(total_equity, 0)")
trailing("29_roic", "net_profit_ttm / nullif(total_equity + total_liab, 0)")

# Three statements of a period, published on different days.
MERGED_SQL = TTM_SQL + ",\ni3 AS (SELECT code, period, q, notice + 5 AS notice, net_profit_ttm, gross_profit_ttm, total_assets, operate_cf_ttm FROM i2)"
for _n, _e in (
    ("30_gpoa", "gross_profit_ttm / nullif(total_assets, 0)"),
    ("30_accruals2", "(coalesce(net_profit_ttm, 0) - coalesce(operate_cf_ttm, 0)) / nullif(total_assets, 0)"),
    ("30_ocf_to_profit", "operate_cf_ttm / nullif(net_profit_ttm, 0)"),
):
    statement(_n, _e, MERGED_SQL, "i3")

# Per market value, with the shares of the date; statements in tens of thousands.
MV = ", bc AS (SELECT b.code, b.date, b.close * c.total_shares / 10000 AS mv FROM bars b ASOF LEFT JOIN capital c ON b.code = c.code AND b.date >= c.date)\nSELECT b.code, b.date, {e} AS value FROM bc b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.known"


def valued(name: str, item: str, invert: bool = False, sql: str = TTM_SQL, t: str = "i2") -> None:
    """item over market value; invert: as one over the ratio of market value to the item, null where that is 0."""
    e = "1 / nullif(mv / nullif(value, 0), 0)" if invert else "value / nullif(mv, 0)"
    C.add(f"FA_{name}", factor(name), sql + LADDER.format(t=t, v=item) + MV.format(e=e))


for _n, _x in (("07_bp", "total_equity"), ("07_sp", "revenue"), ("07_ocfp", "operate_cf")):
    valued(_n, _x, sql=ITEMS, t="i0")
valued("31_ep", "net_profit_ttm", invert=True)
valued("31_bp", "total_equity", invert=True)
valued("32_sp_ttm", "revenue_ttm")
valued("32_cfp_ttm", "operate_cf_ttm")

# Value against its own past, and with growth.
EP_SQL = TTM_SQL + LADDER.format(t="i2", v="net_profit_ttm") + MV.replace("SELECT b.code, b.date, {e} AS value", ", ep AS (SELECT b.code, b.date, value / nullif(mv, 0) AS ep").replace("\n,", ",\n") + ")"


_EPD = f", z AS (SELECT code, date, CASE WHEN count(ep) OVER (w ROWS 59 PRECEDING) >= 45 AND min(ep) OVER (w ROWS 59 PRECEDING) < max(ep) OVER (w ROWS 59 PRECEDING) THEN least(greatest((ep - avg(ep) OVER (w ROWS 59 PRECEDING)) / stddev_samp(ep) OVER (w ROWS 59 PRECEDING), -10), 10) END AS z FROM ep {W})"
C.add("FA_20_epd_60", factor("20_epd_60"), EP_SQL + _EPD + " SELECT code, date, z AS value FROM z", digits=3)
C.add("FA_20_epds_60", factor("20_epds_60"), EP_SQL + _EPD + f", x AS (SELECT code, date, CASE WHEN count(z) OVER (w ROWS 59 PRECEDING) >= 45 AND stddev_samp(z) OVER (w ROWS 59 PRECEDING) > 1e-12 THEN least(greatest(avg(z) OVER (w ROWS 59 PRECEDING) / stddev_samp(z) OVER (w ROWS 59 PRECEDING), -10), 10) END AS value FROM z {W}) SELECT code, date, value FROM x", digits=3)
# 1,250 days are 250 weeks, 500 are 100.
_BEFORE = "(w ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"
C.add("FA_39_ep_z5", factor("39_ep_z5"), EP_SQL + f", x AS (SELECT code, date, CASE WHEN count(ep) OVER {_BEFORE} >= 100 AND min(ep) OVER {_BEFORE} < max(ep) OVER {_BEFORE} THEN (ep - avg(ep) OVER {_BEFORE}) / stddev_samp(ep) OVER {_BEFORE} END AS value FROM ep {W}) SELECT code, date, value FROM x", digits=3)


C.add("FA_39_garp", factor("39_garp"), EP_SQL + LADDER.format(t="i2", v="(net_profit - net_profit_y) / nullif(abs(net_profit_y), 0)").replace("kept", "kept2").replace("ladder", "ladder2") + """, j AS (SELECT ep.code, ep.date, round(ep.ep, 9) AS e, round(l.value, 9) AS g FROM ep ASOF JOIN ladder2 l ON ep.code = l.code AND ep.date >= l.known WHERE ep.ep IS NOT NULL)
SELECT code, date, rank() OVER (PARTITION BY date ORDER BY e) * rank() OVER (PARTITION BY date ORDER BY g) AS value FROM j""")

# Surprises: against the rows before, against what was published by then, and from forecasts.
for _n, _x in (("37_sue_v2", "net_profit"), ("37_sur", "revenue")):
    C.add(f"FA_{_n}", factor(_n), f"""z AS (SELECT code, period, notice, least(greatest(({_x} - avg({_x}) OVER v) / nullif(stddev_samp({_x}) OVER v, 0), -10), 10) AS value, count({_x}) OVER v AS n FROM items WINDOW v AS (PARTITION BY code ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
ladder AS (SELECT * FROM (SELECT code, notice AS known, CASE WHEN n >= 6 THEN value END AS value, row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) AS k FROM z) WHERE k = 1 AND value IS NOT NULL)
""" + ON_BARS, digits=3)  # fmt: skip


C.add("FA_37_roe_chg", factor("37_roe_chg"), TTM_SQL + """, r AS (SELECT code, period, q, notice, net_profit_ttm / nullif(total_equity, 0) AS roe FROM i2), r4 AS (SELECT a.code, a.period, a.notice, a.roe - b.roe AS value FROM r a JOIN r b ON a.code = b.code AND b.q = a.q - 4),
ladder AS (SELECT * FROM (SELECT code, notice AS known, value, row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) AS k FROM r4 WHERE value IS NOT NULL) WHERE k = 1)
""" + ON_BARS)
GPOA = TTM_SQL + """, gp AS (SELECT code, period, q, notice, gross_profit_ttm / nullif(total_assets, 0) AS g FROM i2),
pc AS (SELECT c.code, c.period, c.q, c.notice, c.g, p.q AS pq, p.g AS pg, row_number() OVER (PARTITION BY c.code, c.period ORDER BY p.q DESC) AS k FROM gp c JOIN gp p ON p.code = c.code AND p.q < c.q AND p.notice <= c.notice AND p.g IS NOT NULL WHERE c.g IS NOT NULL)
"""
NEWEST = """, ladder AS (SELECT * FROM (SELECT code, notice AS known, value, row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) AS k FROM v0 WHERE value IS NOT NULL) WHERE k = 1)
""" + ON_BARS


C.add("FA_38_sue_gpoa", factor("38_sue_gpoa"), GPOA + ", v0 AS (SELECT code, period, notice, CASE WHEN count(pg) >= 6 THEN least(greatest((any_value(g) - avg(pg)) / nullif(stddev_samp(pg), 0), -10), 10) END AS value FROM pc WHERE k <= 8 GROUP BY 1, 2, 3)" + NEWEST, digits=3)
C.add("FA_38_gpoa_chg", factor("38_gpoa_chg"), GPOA + ", v0 AS (SELECT code, period, notice, CASE WHEN pq = q - 4 THEN g - pg END AS value FROM pc WHERE k = 4)" + NEWEST)

FORECASTS = "fc AS (SELECT code, period, q, period + CAST(1 + (CAST(code AS BIGINT) * 3 + quarter(period) * 11) % 14 AS INTEGER) AS known, round(net_profit * 0.9, 0) AS low, CASE WHEN CAST(code AS BIGINT) % 3 > 0 THEN round(net_profit * 1.2, 0) END AS high FROM items WHERE CAST(code AS BIGINT) % 4 > 0)"


_PARAMETERS = """d1 AS (SELECT a.code, a.period, a.q, a.notice, a.net_profit - b.net_profit AS d FROM items a JOIN items b ON a.code = b.code AND b.q = a.q - 4),
d2 AS (SELECT *, avg(d) OVER v AS delta, count(d) OVER v AS n FROM d1 WINDOW v AS (PARTITION BY code ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)),
d3 AS (SELECT *, d - delta AS e FROM d2 WHERE n >= 4),
d4 AS (SELECT *, stddev_samp(e) OVER v AS sigma, count(e) OVER v AS m FROM d3 WINDOW v AS (PARTITION BY code ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)),
d5 AS (SELECT * FROM d4 WHERE m >= 4 AND sigma > 1e-12)
"""
_PREDICTED = FORECASTS + ", " + _PARAMETERS + """, par AS (SELECT * FROM d5 QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1),
fb AS (SELECT fc.code, fc.q, fc.known, CASE WHEN high IS NOT NULL THEN (low + high) / 2 ELSE low END AS est, b.net_profit AS y FROM fc JOIN items b ON b.code = fc.code AND b.q = fc.q - 4 AND b.notice <= fc.known),
fv AS (SELECT fb.code, fb.q, fb.known, least(greatest((est - y - delta) / sigma, -10), 10) AS value FROM fb ASOF JOIN par ON par.code = fb.code AND fb.known >= par.notice),
pred AS (SELECT code, known, value FROM fv WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, known ORDER BY q DESC) = 1)
"""
C.add("FA_35_sue_pred", factor("35_sue_pred"), _PREDICTED + ON_BARS.replace("ladder", "pred"), digits=3)


C.add("FA_36_sue_i", factor("36_sue_i"), _PREDICTED + """, own AS (SELECT code, notice AS known, least(greatest((d - delta) / sigma, -10), 10) AS value FROM d5 QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1),
ev AS (SELECT code, known, avg(value) AS value FROM (SELECT * FROM own UNION ALL SELECT * FROM pred) GROUP BY 1, 2)
SELECT b.code, b.date, sum((90 - date_diff('day', e.known, b.date)) * e.value) / sum(90 - date_diff('day', e.known, b.date)) AS value FROM bars b LEFT JOIN ev e ON e.code = b.code AND e.known BETWEEN b.date - 89 AND b.date GROUP BY 1, 2""", digits=3)

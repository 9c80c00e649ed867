"""Day features of minute bars in full, and the factors that average them, against SQL."""

from __future__ import annotations

from panelwright.catalog import fixtures as X
from panelwright.catalog.named import factor
from panelwright.plans import minutes as M

C = X.Catalog()
#: The fixture's days have fewer bars than a market's.
BARS = 30

# The same from the day's bars as lists in the order of time, one query for each family of features.
FEATURES = """days AS (
  SELECT code, date, count(*) AS n, list(open ORDER BY datetime) AS o, list(high ORDER BY datetime) AS h, list(low ORDER BY datetime) AS l, list(close ORDER BY datetime) AS c, list(vol ORDER BY datetime) AS v, list(amount ORDER BY datetime) AS a, list(hour(datetime) ORDER BY datetime) AS hours
  FROM minutes WHERE close > 0 GROUP BY code, date),
moves AS (SELECT *, [NULL::DOUBLE] || list_transform(range(2, n + 1), lambda i: ln(c[i] / c[i - 1])) AS r, len(list_filter(hours, lambda x: x < 6)) AS n6, len(list_filter(hours, lambda x: x < 12)) AS n12, len(list_filter(hours, lambda x: x < 18)) AS n18 FROM days),
price_path AS (
  SELECT code, date, c[n] AS close, list_max(h) - list_min(l) AS day_range, list_position(h, list_max(h)) / n AS hi_pos, list_position(l, list_min(l)) / n AS lo_pos,
    CASE WHEN n6 > 0 THEN c[n6] / o[1] - 1 END AS r_first, CASE WHEN n12 > 0 THEN c[n12] / o[1] - 1 END AS r_am, CASE WHEN n12 > 0 THEN c[n] / c[n12] - 1 END AS r_pm, CASE WHEN n18 > 0 THEN c[n] / c[n18] - 1 END AS r_last
  FROM moves),
profile AS (
  SELECT code, date, list_sum(v[1:n12]) AS v_am, list_sum(v[n12 + 1:n]) AS v_pm, list_sum(v[1:n6]) / list_sum(v) AS v_open, list_sum(v[n18 + 1:n]) / list_sum(v) AS v_close,
    list_max(v) / list_sum(v) AS v_top1, list_sum(list_transform(v, lambda x: (x / list_sum(v)) ** 2)) AS v_hhi
  FROM moves),
variation AS (
  SELECT code, date, list_sum(list_transform(r, lambda x: x ** 2)) AS rv, list_sum(list_transform(r, lambda x: x ** 3)) AS sum_r3, list_sum(list_transform(r, lambda x: x ** 4)) AS sum_r4,
    list_sum(list_transform(list_filter(r, lambda x: x < 0), lambda x: x ** 2)) AS rs_neg, list_sum(list_transform(list_filter(r, lambda x: x > 0), lambda x: x ** 2)) AS rs_pos,
    pi() / 2 * list_sum(list_transform(range(3, n + 1), lambda i: abs(r[i] * r[i - 1]))) AS bv
  FROM moves),
bars_again AS (SELECT code, date, unnest(range(1, n + 1)) AS i, unnest(r) AS r, unnest(v) AS v, unnest(a) AS a FROM moves),
liquidity AS (SELECT code, date, count(*) AS n_min, sum(a) AS amt_sum, sum(a) / sum(v) AS vwap, avg(abs(r)) AS abi, avg(abs(r) / nullif(a, 0)) AS amihud_min, corr(r, v) AS corr_rv FROM bars_again GROUP BY code, date),
ahead AS (
  SELECT code, date, r, v, a, coalesce(sum(v) OVER (PARTITION BY code, date ORDER BY round(abs(r) / greatest(v, 1) ** 0.25, 9) DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(v) OVER (PARTITION BY code, date) AS informed,
    coalesce(sum(v) OVER (PARTITION BY code, date ORDER BY v DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(v) OVER (PARTITION BY code, date) AS busy
  FROM bars_again WHERE v > 0 AND r IS NOT NULL),
tops AS (SELECT code, date, sum(a) FILTER (WHERE informed) / sum(v) FILTER (WHERE informed) AS informed_price, sum(r) FILTER (WHERE busy) AS topv_r, coalesce(sum(v) FILTER (WHERE busy AND r > 0), 0) / sum(v) FILTER (WHERE busy) AS topv_upr FROM ahead GROUP BY code, date),
f AS (SELECT * EXCLUDE (informed_price), informed_price / vwap AS smart_q FROM price_path JOIN profile USING (code, date) JOIN variation USING (code, date) JOIN liquidity USING (code, date) JOIN tops USING (code, date))
"""
COLUMNS = ("rv", "bv", "rs_pos", "rs_neg", "sum_r3", "sum_r4", "abi", "v_open", "v_close", "v_am", "v_pm", "v_hhi", "v_top1", "r_first", "r_last", "r_am", "r_pm", "hi_pos", "lo_pos", "vwap", "amihud_min", "corr_rv", "day_range", "amt_sum", "close", "topv_r", "topv_upr", "smart_q")


def features(s, d):
    return M.day_features(X.minutes(s, d))


C.add("MIN_01_features_in_full", features, FEATURES + "SELECT * FROM f", values=COLUMNS)

_SQL = {
    "rv": "ln(1e4 * rv)", "rjv": "greatest(rv - bv, 0) / rv", "rsk": "sqrt(n_min) * sum_r3 / power(rv, 1.5)", "rku": "n_min * sum_r4 / (rv * rv)", "dsem": "rs_neg / rv", "vopen": "v_open", "vclose": "v_close", "vhhi": "v_hhi", "vampp": "v_am / nullif(v_pm, 0)", "rlast30": "r_last",
    "rfirst30": "r_first", "hipos": "hi_pos", "amihud": "ln(1 + amihud_min)", "amtrange": "ln(1 + amt_sum / nullif(day_range, 0))", "vwapbias": "close / nullif(vwap, 0) - 1", "corr_rv": "corr_rv", "smartq": "smart_q", "topvr": "topv_r", "topvupr": "topv_upr", "rvvol": "ln(1e4 * rv)",
}
for _name, _window, _least in [(n, 20, 15) for n in _SQL] + [("smartq", 10, 8)]:  # rows, and those that must be there
    _over = f"OVER (PARTITION BY code ORDER BY date ROWS {_window - 1} PRECEDING)"
    _value = f"stddev_samp(x) {_over} / nullif(avg(x) {_over}, 0)" if _name == "rvvol" else f"avg(x) {_over}"
    C.add(f"FA_40_{_name}_{_window}", factor(f"40_{_name}_{_window}"), FEATURES + f", x AS (SELECT code, date, {_SQL[_name]} AS x FROM f WHERE n_min >= {BARS} AND rv > 0) SELECT code, date, CASE WHEN count(x) {_over} >= {_least} THEN {_value} END AS value FROM x")

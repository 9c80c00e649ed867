"""Portfolio sweeps, statement merges, rolling models, and more factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.books import _features
from panelwright.catalog.judging import BUCKETS, factors, features, joined
from panelwright.catalog.judging import SQL as JUDGING
from panelwright.catalog.named import factor
from panelwright.functions.elementwise import clip
from panelwright.operators import panel, ts, xs
from panelwright.plans import evaluate as ev
from panelwright.plans import rolling

C = X.Catalog()
B = X.bars


def _sweep(s, d):
    """Mean next return of the top n by amount for several n and phases, in one job."""
    b = panel.forward_returns(B(s, d), (4,)).where("fwd_4 is not null")
    days = b.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    r = b.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("amount"), "code"))).where("r <= 30").join(F.broadcast(days), "date")
    grid = r.withColumn("n", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30)))).where("r <= n").withColumn("phase", F.col("i") % 4)
    return grid.groupBy("n", "phase", "date").agg(F.avg("fwd_4").alias("x")).groupBy("n", "phase").agg(F.count("*").alias("k"), F.avg("x").alias("value"))


C.add("PF_31_sweep", _sweep, """f AS (SELECT date, code, amount, lead(close, 4) OVER (PARTITION BY code ORDER BY date) / close - 1 AS f FROM bars), u AS (SELECT * FROM f WHERE f IS NOT NULL),
i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM u)), r AS (SELECT u.*, i % 4 AS phase, row_number() OVER (PARTITION BY u.date ORDER BY amount DESC, code) AS r FROM u JOIN i ON i.date = u.date),
m AS (SELECT n, phase, date, avg(f) AS x FROM r CROSS JOIN (VALUES (10), (20), (30)) g(n) WHERE r <= n GROUP BY 1, 2, 3)
SELECT n, CAST(phase AS INTEGER) AS phase, count(*) AS k, avg(x) AS value FROM m GROUP BY 1, 2""", dates=())


def _net_of_fees(s, d):
    """Mean bucket return less fee times the bucket's turnover, for two fee levels."""
    q = ev.quantile_returns(joined(s, d, (4,)), 4, 5).groupBy("factor", "q").agg(F.avg("ret").alias("ret"))
    t = ev.bucket_turnover(factors(s, d).join(F.broadcast(panel.every_kth(B(s, d), 4)), "date", "left_semi"), 5, 5).groupBy("factor").agg(F.avg("turnover").alias("t"))
    j = q.where("q = 5").join(t, "factor").withColumn("fee", F.explode(F.array(F.lit(0.001), F.lit(0.003))))
    return j.select("factor", "fee", (F.col("ret") - F.col("fee") * F.col("t")).alias("value"))


C.add("PF_27_net_of_fees", _net_of_fees, JUDGING + BUCKETS.format(n=5) + """, fq AS (SELECT * FROM (SELECT factor, date, code, ntile(5) OVER (PARTITION BY factor, date ORDER BY value, code) AS q FROM factors SEMI JOIN g USING (date) WHERE value IS NOT NULL) WHERE q = 5),
fi AS (SELECT factor, date, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM (SELECT DISTINCT factor, date FROM factors SEMI JOIN g USING (date))),
fk AS (SELECT factor, date, i, code FROM fq JOIN fi USING (factor, date)),
ft AS (SELECT factor, avg(t) AS t FROM (SELECT a.factor, a.date, 1 - count(b.code) / count(*) AS t FROM fk a LEFT JOIN fk b ON a.factor = b.factor AND a.code = b.code AND b.i = a.i - 1 WHERE a.i > 1 GROUP BY 1, 2) GROUP BY 1)
SELECT b.factor, CAST(fee AS DOUBLE) AS fee, b.ret - fee * t AS value FROM (SELECT factor, avg(ret) AS ret FROM buckets WHERE q = 5 GROUP BY 1) b JOIN ft ON ft.factor = b.factor CROSS JOIN (VALUES (0.001), (0.003)) v(fee)""", dates=())


def _statements(s, d):
    """Two statements of a period, each with its newest version, merged; a period is dropped once a later one is out."""
    r = X.reports(s, d)
    a = panel.latest(r.select("code", "period", "notice", "revenue"), ["code", "period"], [F.desc("notice")])
    b = panel.latest(r.select("code", "period", F.date_add("notice", 5).alias("later"), "net_profit"), ["code", "period"], [F.desc("later")])
    m = a.join(b, ["code", "period"]).withColumn("known", F.greatest("notice", "later"))
    after = F.min("known").over(Window.partitionBy("code").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("after", after).where("after is null or after > known").select("code", "period", "known", (F.col("net_profit") / F.col("revenue")).alias("value"))


C.add("PIT_04_statements", _statements, "SELECT code, period, known, net_profit / revenue AS value FROM (SELECT *, notice + 5 AS known, min(notice + 5) OVER (PARTITION BY code ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM reports) WHERE after IS NULL OR after > known", dates=("period", "known"))


RIDGE = 0.01


def _learned(s, d):
    x = features(s, d, ("mom_4", "size"))
    y = B(s, d).select("date", "code", clip(panel.forward_return("close", 4), -0.5, 0.5).alias("label"))
    m = x.join(y, ["date", "code"]).withColumns({"half": rolling.half_year(F.col("date")), "large": (F.col("size") > 0.5).cast("int")})
    return m.select("date", "code", "half", "large", "mom_4", "size", "label")


def _rolling_model(s, d, by=()):
    """A linear model of two ranked factors, fitted on two years and used on the next half-year, for each half-year that has two years before it in the table (and each domain)."""
    m, names = _learned(s, d), ["mom_4", "size"]
    return rolling.predicted(m, rolling.fits(m, names, "label", "half", 4, RIDGE, by), names, "half", by).select("date", "code", *by, "score")


def _rolling_sql(by: str) -> str:
    """by: the domain's column with a comma, or nothing."""
    return JUDGING + f""", rk AS (SELECT date, code, factor, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY factor, date) AS r FROM factors WHERE value IS NOT NULL AND factor <> 'vol_12'),
pv AS (SELECT date, code, max(r) FILTER (WHERE factor = 'mom_4') AS x, max(r) FILTER (WHERE factor = 'size') AS z FROM rk GROUP BY 1, 2),
m AS (SELECT date, code, CAST(year(date) * 2 + CAST(month(date) > 6 AS INTEGER) AS INTEGER) AS half, CAST(z > 0.5 AS INTEGER) AS large, x, z, least(greatest(fwd_4, -0.5), 0.5) AS y FROM pv JOIN fwd USING (date, code) WHERE x IS NOT NULL AND z IS NOT NULL),
h AS (SELECT DISTINCT {by} half FROM m),
c AS (SELECT {by.replace('large', 'h.large')} h.half, var_pop(x) * {1 + RIDGE} AS xx, var_pop(z) * {1 + RIDGE} AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my
  FROM h JOIN m ON {'m.large = h.large AND ' if by else ''} m.half BETWEEN h.half - 4 AND h.half - 1 WHERE y IS NOT NULL AND h.half - 4 >= (SELECT min(half) FROM m q {'WHERE q.large = h.large' if by else ''}) GROUP BY {'1, 2' if by else '1'}),
k AS (SELECT {by} half, mx, mz, my, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM c)
SELECT date, code, {by} my + bx * (x - mx) + bz * (z - mz) AS score FROM m JOIN k USING ({by} half)"""


C.add("ML_03_rolling", _rolling_model, _rolling_sql(""), values=("score",))
C.add("ML_03_rolling_by_size", lambda s, d: _rolling_model(s, d, ("large",)), _rolling_sql("large,"), values=("score",))


# Factors
def add(name, body, **k):
    C.add(f"FA_{name}", factor(name), body, **k)


W = "WINDOW w AS (PARTITION BY code ORDER BY date)"
add("45_trailing_yield", "SELECT b.code, b.date, coalesce(sum(a.cash), 0) / any_value(b.close) AS value FROM bars b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date - 364 AND b.date GROUP BY 1, 2")
_EP = """ladder AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1),
ep AS (SELECT b.code, b.date, l.net_profit / (b.close * 1000) AS ep, b.vol FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.notice)
"""


add("07_ep", _EP + "SELECT code, date, ep AS value FROM ep")
add("08_ep_size_half", _EP + """, h AS (SELECT code, date, round(ep.ep, 9) AS e, CAST(amount >= quantile_cont(amount, 0.5) OVER (PARTITION BY date) AS INTEGER) AS half FROM ep JOIN bars USING (code, date))
SELECT code, date, CASE WHEN e IS NOT NULL THEN (rank() OVER (PARTITION BY date, half ORDER BY e NULLS LAST) + (count(*) OVER (PARTITION BY date, half, e) - 1) / 2.0) / count(e) OVER (PARTITION BY date, half) END AS value FROM h""")
add("20_ep_zscore", _EP + f", x AS (SELECT code, date, CASE WHEN count(ep) OVER (w ROWS 29 PRECEDING) >= 15 AND min(ep) OVER (w ROWS 29 PRECEDING) < max(ep) OVER (w ROWS 29 PRECEDING) THEN (ep - avg(ep) OVER (w ROWS 29 PRECEDING)) / stddev_samp(ep) OVER (w ROWS 29 PRECEDING) END AS value FROM ep {W}) SELECT code, date, value FROM x", digits=3)
add("39_ep_rank_product", _EP + f", k AS (SELECT ep.code, ep.date, round(ep.ep, 9) AS e, close / lag(close, 4) OVER (PARTITION BY bars.code ORDER BY bars.date) - 1 AS m FROM ep JOIN bars ON bars.code = ep.code AND bars.date = ep.date) SELECT code, date, rank() OVER (PARTITION BY date ORDER BY e) * rank() OVER (PARTITION BY date ORDER BY m) AS value FROM k WHERE e IS NOT NULL AND m IS NOT NULL")


add("34_acceleration", """q AS (SELECT *, year(period) * 4 + quarter(period) AS q FROM reports), g AS (SELECT a.code, a.period, a.notice, a.q, (a.revenue - b.revenue) / abs(b.revenue) AS g FROM q a JOIN q b ON a.code = b.code AND a.q = b.q + 4),
v AS (SELECT *, CASE WHEN lag(q) OVER w = q - 1 THEN least(greatest(g - lag(g) OVER w, -5), 5) END AS value FROM g WINDOW w AS (PARTITION BY code ORDER BY q)),
ladder AS (SELECT * FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1)
SELECT b.code, b.date, l.value FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.notice""")

# Means of minute features over ten days
_HF = {"40_hf_rv": ("ln(rv)", F.ln), "40_hf_hhi": ("hhi", None), "40_hf_top1": ("top1", None), "40_hf_open": ("v_open", None), "40_hf_close": ("v_close", None)}
_MIN = """r AS (SELECT *, ln(close / lag(close) OVER v) AS r, hour(datetime) AS hh FROM minutes WHERE close > 0 WINDOW v AS (PARTITION BY code, date ORDER BY datetime)), q AS (SELECT *, sum(vol) OVER (PARTITION BY code, date) AS dv FROM r),
f AS (SELECT code, date, sum(r * r) AS rv, sum((vol / dv) ** 2) AS hhi, max(vol) / sum(vol) AS top1, sum(vol) FILTER (WHERE hh < 6) / sum(vol) AS v_open, sum(vol) FILTER (WHERE hh >= 18) / sum(vol) AS v_close FROM q GROUP BY 1, 2)
"""
for _n, (_x, _g) in _HF.items():
    _c = _x.removeprefix("ln(").removesuffix(")")
    C.add(f"FA_{_n}_10", lambda s, d, c=_c, g=_g: _features(s, d).withColumn("x", g(c) if g else F.col(c)).select("code", "date", ts.mean("x", 10, 5).alias("value")), _MIN + f", x AS (SELECT code, date, CASE WHEN count({_x}) OVER (w ROWS 9 PRECEDING) >= 5 THEN avg({_x}) OVER (w ROWS 9 PRECEDING) END AS value FROM f {W}) SELECT code, date, value FROM x")

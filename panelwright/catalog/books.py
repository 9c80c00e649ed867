"""Minute features, portfolios, universes, corporate actions, event studies, data quality, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.functions.elementwise import finite, guarded_log, safe_div
from panelwright.operators import asof, panel, ts, xs
from panelwright.streaming import bars as stream

C = X.Catalog()
B = X.bars
M = X.minutes


def _day():
    return Window.partitionBy("code", "date").orderBy("datetime")


# Minute to day
MIN_SQL = """r AS (SELECT *, ln(close / lag(close) OVER v) AS r, row_number() OVER v AS i, hour(datetime) AS hh FROM minutes WHERE close > 0 WINDOW v AS (PARTITION BY code, date ORDER BY datetime)),
q AS (SELECT *, lag(abs(r)) OVER (PARTITION BY code, date ORDER BY datetime) AS r0, sum(vol) OVER (PARTITION BY code, date) AS dv FROM r)
"""


def _features(s, d):
    m = M(s, d).where("close > 0").withColumns({"r": F.ln(F.col("close") / F.lag("close").over(_day())), "hh": F.hour("datetime")})
    m = m.withColumns({"r0": F.lag(F.abs("r")).over(_day()), "dv": F.sum("vol").over(Window.partitionBy("code", "date"))})
    r2 = F.col("r") * F.col("r")
    return m.groupBy("code", "date").agg(
        F.count("*").alias("n_min"), F.sum(r2).alias("rv"), (F.sum(F.abs("r") * F.col("r0")) * F.pi() / 2).alias("bv"), F.sum(F.signum("r") * r2).alias("srv"), F.sum(r2 * F.col("r")).alias("r3"), F.sum(r2 * r2).alias("r4"),
        (F.sum(F.when(F.col("hh") < 6, F.col("vol"))) / F.sum("vol")).alias("v_open"), (F.sum(F.when(F.col("hh") >= 18, F.col("vol"))) / F.sum("vol")).alias("v_close"), F.sum(F.pow(F.col("vol") / F.col("dv"), F.lit(2))).alias("hhi"), (F.max("vol") / F.sum("vol")).alias("top1"),
        (F.sum("amount") / F.sum("vol")).alias("vwap"), F.max("high").alias("high"), F.min("low").alias("low"),
    )


C.add("MIN_01_day_features", _features, MIN_SQL + """SELECT code, date, count(*) AS n_min, sum(r * r) AS rv, sum(abs(r) * r0) * pi() / 2 AS bv, sum(sign(r) * r * r) AS srv, sum(r * r * r) AS r3, sum(r * r * r * r) AS r4, sum(vol) FILTER (WHERE hh < 6) / sum(vol) AS v_open, sum(vol) FILTER (WHERE hh >= 18) / sum(vol) AS v_close,
sum((vol / dv) ** 2) AS hhi, max(vol) / sum(vol) AS top1, sum(amount) / sum(vol) AS vwap, max(high) AS high, min(low) AS low FROM q GROUP BY 1, 2""", values=("rv", "bv", "srv", "r3", "r4", "v_open", "v_close", "hhi", "top1", "vwap", "high", "low"))


def _top_share(order, out):
    def run(s, d):
        m = M(s, d).where("close > 0").withColumn("r", F.ln(F.col("close") / F.lag("close").over(_day())))
        m = m.withColumn("k", F.round(order(), 9)).where("k is not null")
        w = Window.partitionBy("code", "date").orderBy(F.desc("k"), "datetime").rowsBetween(Window.unboundedPreceding, 0)
        m = m.withColumn("cum", F.sum("vol").over(w) / F.sum("vol").over(Window.partitionBy("code", "date")))
        top = F.col("cum") <= 0.2
        return m.groupBy("code", "date").agg(safe_div(F.sum(F.when(top, F.col("amount"))) / F.sum(F.when(top, F.col("vol"))), F.sum("amount") / F.sum("vol")).alias(out))

    return run


def _top_sql(order):
    return MIN_SQL + f""", k AS (SELECT *, round({order}, 9) AS k FROM q),
c AS (SELECT *, sum(vol) OVER (PARTITION BY code, date ORDER BY k DESC, datetime ROWS UNBOUNDED PRECEDING) / sum(vol) OVER (PARTITION BY code, date) AS cum FROM k WHERE k IS NOT NULL)
SELECT code, date, sum(amount) FILTER (WHERE cum <= 0.2) / sum(vol) FILTER (WHERE cum <= 0.2) / (sum(amount) / sum(vol)) AS value FROM c GROUP BY 1, 2"""


C.add("MIN_02_smart_minutes", _top_share(lambda: F.abs("r") / F.pow("vol", F.lit(0.25)), "value"), _top_sql("abs(r) / vol ** 0.25"))
C.add("MIN_03_top_volume", _top_share(lambda: F.col("vol"), "value"), _top_sql("vol"))


def _reconciled(s, d):
    up = M(s, d).groupBy("code", "date").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.sum("vol").alias("v"))
    e = X.table(s, d, "events").groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("date")).agg(F.max("value").alias("dh"), F.min("value").alias("dl"), (F.count("*") + F.sum(F.col("user_id") % 7)).cast("double").alias("dv"))
    err = F.greatest(F.abs(F.col("h") / F.col("dh") - 1), F.abs(F.col("v") / F.col("dv") - 1))
    return up.join(e, ["code", "date"]).select("code", "date", F.when(err < 1e-9, "pass").when(err < 0.02, "warn").otherwise("fail").alias("verdict"))


C.add("MIN_04_reconcile", _reconciled, "SELECT DISTINCT code, date, 'pass' AS verdict FROM minutes", values=())
C.add("MIN_05_cutoff", lambda s, d: M(s, d).where(F.hour("datetime") < 18).groupBy("code", "date").agg(F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close")).withColumn("next_open", F.lead("open").over(ts.along())), """c AS (SELECT code, date, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close FROM minutes WHERE hour(datetime) < 18 GROUP BY 1, 2)
SELECT *, lead(open) OVER (PARTITION BY code ORDER BY date) AS next_open FROM c""", values=("open", "high", "low", "close", "next_open"))
C.add("MIN_06_entry_curve", lambda s, d: M(s, d).where("close > 0").withColumn("r", F.first("close").over(_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 0 + F.last("close").over(_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / F.col("close") - 1).groupBy("code", F.hour("datetime").alias("hour")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")), """c AS (SELECT code, hour(datetime) AS hour, last_value(close) OVER (PARTITION BY code, date ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / close - 1 AS r FROM minutes WHERE close > 0)
SELECT code, CAST(hour AS INTEGER) AS hour, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM c GROUP BY 1, 2""", dates=(), values=("mean", "sd"))
C.add("MIN_07_buckets", lambda s, d: B(s, d).withColumn("a", ts.rolling("amount", 20, "avg", 10, last=-1)).select("code", "date", xs.ntile("a", 5).alias("bucket")).where("bucket is not null"), """a AS (SELECT code, date, CASE WHEN count(amount) OVER v >= 10 THEN avg(amount) OVER v END AS a FROM bars WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT code, date, CAST(ntile(5) OVER (PARTITION BY date ORDER BY a, code) AS INTEGER) AS bucket FROM a WHERE a IS NOT NULL""", values=())


def _tide(s, d):
    m = M(s, d).withColumn("s", F.sum("vol").over(_day().rowsBetween(-4, 4)))
    peak = Window.partitionBy("code", "date")
    m = m.withColumn("peak", F.max_by("datetime", F.struct("s", F.col("datetime"))).over(peak))
    return m.groupBy("code", "date").agg(F.max("s").alias("top"), F.min(F.when(F.col("datetime") <= F.col("peak"), F.col("s"))).alias("before"), F.min(F.when(F.col("datetime") >= F.col("peak"), F.col("s"))).alias("after"))


C.add("MIN_08_tide", _tide, """s AS (SELECT *, sum(vol) OVER (PARTITION BY code, date ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM minutes),
p AS (SELECT *, first_value(datetime) OVER (PARTITION BY code, date ORDER BY s DESC, datetime DESC) AS peak FROM s)
SELECT code, date, max(s) AS top, min(s) FILTER (WHERE datetime <= peak) AS before, min(s) FILTER (WHERE datetime >= peak) AS after FROM p GROUP BY 1, 2""", values=())


def _surge(s, d):
    day = Window.partitionBy("code", "date")
    m = M(s, d).withColumn("dv", F.col("vol") - F.lag("vol").over(_day()))
    m = m.withColumns({"hot": F.col("dv") > F.avg("dv").over(day) + F.stddev_samp("dv").over(day), "next5": F.avg("close").over(_day().rowsBetween(0, 4))})
    return m.where("hot").groupBy("code", "date").agg(F.count("*").alias("n"), F.avg("next5").alias("mean"))


C.add("MIN_09_surge", _surge, """v AS (SELECT *, vol - lag(vol) OVER (PARTITION BY code, date ORDER BY datetime) AS dv, avg(close) OVER (PARTITION BY code, date ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS next5 FROM minutes),
h AS (SELECT *, dv > avg(dv) OVER (PARTITION BY code, date) + stddev_samp(dv) OVER (PARTITION BY code, date) AS hot FROM v)
SELECT code, date, count(*) AS n, avg(next5) AS mean FROM h WHERE hot GROUP BY 1, 2""", values=("mean",))


def _radar(s, d):
    m = M(s, d)
    k = m.groupBy("date", "datetime").agg(F.avg("close").alias("mk"))
    return m.join(k, ["date", "datetime"]).groupBy("code", "date").agg(F.when(F.count("*") >= 5, finite(F.corr("close", "mk"))).alias("value"))


C.add("MIN_11_radar", _radar, "SELECT code, date, CASE WHEN count(*) >= 5 THEN corr(close, mk) END AS value FROM (SELECT *, avg(close) OVER (PARTITION BY datetime) AS mk FROM minutes) GROUP BY 1, 2", digits=3)


def _contest(s, d):
    w = Window.partitionBy("code", "date").orderBy("close", "datetime")
    m = M(s, d).withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("code", "date"))})
    return m.groupBy("code", "date").agg(F.sum(F.col("vol") * (F.col("n") + 1 - 2 * F.col("k"))).alias("value"))


C.add("MIN_12_contest", _contest, "SELECT code, date, sum(vol * (n + 1 - 2 * k)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY close, datetime) AS k, count(*) OVER (PARTITION BY code, date) AS n FROM minutes) GROUP BY 1, 2")

# Portfolios
_G = "g AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 4 = 0)"
HELD = f"""{_G},
o AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
t AS (SELECT * FROM o WHERE NOT coalesce(close >= high AND ret > 0.07, false)),
held AS (SELECT date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM t SEMI JOIN g USING (date)) WHERE r <= 10),
p AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM g)
"""


def tradable(b):
    """Bars that could be bought: not closed at their high after rising more than 7 %."""
    b = panel.returns(b)
    return b.where(~F.coalesce((F.col("close") >= F.col("high")) & (F.col("ret") > 0.07), F.lit(False)))


def held(s, d, n: int = 10, k: int = 4):
    b = B(s, d)
    t = tradable(b).join(F.broadcast(panel.every_kth(b, k)), "date", "left_semi")
    return panel.top_per_date(t, "amount", n).select("date", "code")


C.add("PF_01_holdings", held, HELD + "SELECT date, code FROM held", values=())
C.add("PF_02_tradable", lambda s, d: tradable(B(s, d)).select("date", "code"), HELD + "SELECT date, code FROM t", values=())


def _periods(s, d):
    """Return of each holding period: mean over holdings of the last known close before the next grid date over that at the start."""
    b = B(s, d)
    g = panel.every_kth(b, 4)
    g = g.withColumn("until", F.lead("date").over(Window.orderBy("date"))).where("until is not null")
    h = held(s, d).join(F.broadcast(g), "date").select("date", "until", "code")
    a = asof.asof(h, b.select("code", "date", "close"), ["close"])
    z = asof.asof(a.withColumnRenamed("close", "c0"), b.select("code", F.col("date").alias("d1"), "close"), ["close"], left_on="until", right_on="d1")
    return z.groupBy("date").agg(F.avg(F.col("close") / F.col("c0") - 1).alias("ret"), F.count("*").alias("n"))


PERIODS = HELD + """, u AS (SELECT * FROM (SELECT date, lead(date) OVER (ORDER BY date) AS until FROM g) WHERE until IS NOT NULL),
z AS (SELECT h.date, u.until, h.code, b.close AS c0 FROM held h JOIN u USING (date) JOIN bars b ON b.code = h.code AND b.date = h.date),
y AS (SELECT z.date, z.c0, b.close AS c1 FROM z ASOF JOIN bars b ON z.code = b.code AND z.until >= b.date),
periods AS (SELECT date, avg(c1 / c0 - 1) AS ret, count(*) AS n FROM y GROUP BY 1)
"""
C.add("PF_03_period_returns", _periods, PERIODS + "SELECT date, ret, n FROM periods", values=("ret",))


def _turnover(s, d, n: int = 10):
    h = held(s, d)
    k = h.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    h = h.join(F.broadcast(k), "date")
    was = h.select((F.col("k") + 1).alias("k"), "code", F.lit(1).alias("was"))
    return h.join(was, ["k", "code"], "left").groupBy("date").agg((1 - F.sum(F.coalesce("was", F.lit(0))) / F.count("*")).alias("turnover"))


TURNOVER = ", x AS (SELECT date, k, code FROM held JOIN p USING (date)), tv AS (SELECT a.date, 1 - count(b.code) / count(*) AS turnover FROM x a LEFT JOIN x b ON a.code = b.code AND b.k = a.k - 1 GROUP BY 1)\n"
C.add("PF_04_turnover", _turnover, HELD + TURNOVER + "SELECT date, turnover FROM tv", values=("turnover",))
C.add("PF_06_cost", lambda s, d: _periods(s, d).join(_turnover(s, d), "date").select("date", (F.col("ret") - F.col("turnover") * 0.0035).alias("ret")), PERIODS + TURNOVER + "SELECT date, ret - turnover * 0.0035 AS ret FROM periods JOIN tv USING (date)", values=("ret",))


def _performance(s, d):
    p = _periods(s, d).withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))
    p = p.withColumn("dd", F.col("nav") / F.max("nav").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return p.agg(F.count("*").alias("n"), (F.exp(F.avg(F.log1p("ret")) * 13) - 1).alias("annual"), (F.stddev_samp("ret") * 13**0.5).alias("vol"), F.min("dd").alias("drawdown"))


C.add("PF_07_performance", _performance, PERIODS + """, nv AS (SELECT ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS nav, date FROM periods), dd AS (SELECT ret, nav / max(nav) OVER (ORDER BY date) - 1 AS dd FROM nv)
SELECT count(*) AS n, exp(avg(ln(1 + ret)) * 13) - 1 AS annual, stddev_samp(ret) * sqrt(13) AS vol, min(dd) AS drawdown FROM dd""", dates=(), values=("annual", "vol", "drawdown"))
C.add("PF_09_benchmark", lambda s, d: panel.returns(B(s, d)).groupBy("date").agg(F.avg("ret").alias("value")), "SELECT date, avg(r) AS value FROM (SELECT date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) GROUP BY date")


def _inverse_vol(s, d):
    b = panel.returns(B(s, d)).withColumn("sd", ts.rolling("ret", 30, "stddev_pop", 20))
    h = held(s, d).join(b.select("date", "code", "sd"), ["date", "code"]).where("sd > 0")
    return h.select("date", "code", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(Window.partitionBy("date"))).alias("weight"))


C.add("PF_11_inverse_vol", _inverse_vol, HELD + """, sd AS (SELECT date, code, CASE WHEN count(ret) OVER v >= 20 THEN stddev_pop(ret) OVER v END AS sd FROM o WINDOW v AS (PARTITION BY code ORDER BY date ROWS 29 PRECEDING)),
i AS (SELECT date, code, 1 / sd AS w FROM held JOIN sd USING (date, code) WHERE sd > 0)
SELECT date, code, w / sum(w) OVER (PARTITION BY date) AS weight FROM i""", values=("weight",))


def _orders(s, d):
    h = held(s, d)
    days = h.select("date").distinct().orderBy("date").limit(2)
    last = days.agg(F.max("date").alias("b"), F.min("date").alias("a"))
    j = h.join(F.broadcast(last))
    cur, tgt = j.where("date = a").select("code", F.lit(0.1).alias("cur")), j.where("date = b").select("code", F.lit(0.1).alias("tgt"))
    o = cur.join(tgt, "code", "full").withColumn("delta", F.coalesce("tgt", F.lit(0.0)) - F.coalesce("cur", F.lit(0.0)))
    return o.where("abs(delta) >= 0.005").select("code", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), "delta")


C.add("PF_16_orders", _orders, HELD + """, dd AS (SELECT min(date) AS a, max(date) AS b FROM (SELECT DISTINCT date FROM held ORDER BY date LIMIT 2)),
c AS (SELECT code FROM held, dd WHERE date = a), n AS (SELECT code FROM held, dd WHERE date = b)
SELECT code, 'buy' AS side, 0.1 AS delta FROM n WHERE code NOT IN (SELECT code FROM c) UNION ALL SELECT code, 'sell', -0.1 FROM c WHERE code NOT IN (SELECT code FROM n)""", dates=(), values=("delta",))
C.add("PF_17_exposure", lambda s, d: B(s, d).groupBy("date").agg(F.avg("close").alias("m")).withColumns({"f": F.avg("m").over(Window.orderBy("date").rowsBetween(-4, 0)), "g": F.avg("m").over(Window.orderBy("date").rowsBetween(-19, 0))}).select("date", F.when(F.col("f") < F.col("g"), 0.5).otherwise(1.0).alias("value")), "SELECT date, CASE WHEN avg(m) OVER (ORDER BY date ROWS 4 PRECEDING) < avg(m) OVER (ORDER BY date ROWS 19 PRECEDING) THEN 0.5 ELSE 1.0 END AS value FROM (SELECT date, avg(close) AS m FROM bars GROUP BY date)")
C.add("PF_19_capacity", lambda s, d: held(s, d).join(B(s, d).withColumn("adv", ts.mean("amount", 12, 6)).select("date", "code", "adv"), ["date", "code"]).groupBy("date").agg(F.percentile(1000 / F.col("adv"), F.lit(0.5)).alias("mid"), F.count(F.when(1000 / F.col("adv") > 0.02, 1)).alias("over")), HELD + """, a AS (SELECT date, code, CASE WHEN count(amount) OVER v >= 6 THEN avg(amount) OVER v END AS adv FROM bars WINDOW v AS (PARTITION BY code ORDER BY date ROWS 11 PRECEDING))
SELECT date, quantile_cont(1000 / adv, 0.5) AS mid, count(*) FILTER (WHERE 1000 / adv > 0.02) AS over FROM held JOIN a USING (date, code) GROUP BY 1""", values=("mid",))
C.add("PF_25_exclusion", lambda s, d: panel.top_per_date(B(s, d).withColumn("p", xs.rank_pct("vol")).where("p <= 0.8"), "amount", 10).select("date", "code"), "SELECT date, code FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY vol) + (count(*) OVER (PARTITION BY date, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS p FROM bars) WHERE p <= 0.8 QUALIFY row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) <= 10", values=())

# Universes and corporate actions
C.add("UNI_01_pool", lambda s, d: B(s, d).withColumn("age", F.datediff("date", F.min("date").over(Window.partitionBy("code")))).where("age >= 140").join(X.groups(s, d).where("coarse <> '4'"), "code").transform(lambda x: panel.top_per_date(x, "shares", 20)).select("date", "code"), """a AS (SELECT b.date, b.code, date_diff('day', min(b.date) OVER (PARTITION BY b.code), b.date) AS age, g.shares, g.coarse FROM bars b JOIN groups g ON g.code = b.code)
SELECT date, code FROM a WHERE age >= 140 AND coarse <> '4' QUALIFY row_number() OVER (PARTITION BY date ORDER BY shares DESC, code) <= 20""", values=())
C.add("UNI_03_layers", lambda s, d: B(s, d).groupBy(F.trunc("date", "month").alias("month"), "code").agg(F.avg("amount").alias("a")).withColumn("a6", F.avg("a").over(Window.partitionBy("code").orderBy("month").rowsBetween(-5, 0))).withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("a6"), "code"))).select("month", "code", F.when(F.col("r") <= 20, "large").when(F.col("r") <= 50, "mid").otherwise("small").alias("layer")), """m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, avg(amount) AS a FROM bars GROUP BY 1, 2),
s AS (SELECT *, avg(a) OVER (PARTITION BY code ORDER BY month ROWS 5 PRECEDING) AS a6 FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY a6 DESC, code) AS r FROM s)
SELECT month, code, CASE WHEN r <= 20 THEN 'large' WHEN r <= 50 THEN 'mid' ELSE 'small' END AS layer FROM r""", dates=("month",), values=())
C.add("UNI_05_snapshot", lambda s, d: asof.asof(B(s, d).select("code", "date"), X.actions(s, d), ["cash"]), "SELECT b.code, b.date, a.cash FROM bars b ASOF LEFT JOIN actions a ON a.code = b.code AND b.date >= a.date", values=("cash",))
C.add("UNI_08_pool_sizes", lambda s, d: B(s, d).join(X.groups(s, d), "code").groupBy("date", "coarse").agg(F.count("*").alias("n")), "SELECT date, coarse, count(*) AS n FROM bars JOIN groups USING (code) GROUP BY 1, 2", values=())


def board(code):
    """Listing board by the code's prefix."""
    c = F.lpad(code, 6, "0")
    p2, p3 = F.substring(c, 1, 2), F.substring(c, 1, 3)
    return F.when(p3.isin("688", "689"), "STAR").when(p3.isin("300", "301"), "GEM").when(p2.isin("43", "83", "87", "88", "92"), "BJ").otherwise("MAIN")


C.add("UNI_09_board", lambda s, d: X.table(s, d, "part").select("p_partkey", board((F.col("p_partkey") * 4799 % 1000000).cast("string")).alias("board")), """SELECT p_partkey, CASE WHEN substr(c, 1, 3) IN ('688', '689') THEN 'STAR' WHEN substr(c, 1, 3) IN ('300', '301') THEN 'GEM' WHEN substr(c, 1, 2) IN ('43', '83', '87', '88', '92') THEN 'BJ' ELSE 'MAIN' END AS board
FROM (SELECT p_partkey, lpad(CAST(p_partkey * 4799 % 1000000 AS VARCHAR), 6, '0') AS c FROM part)""", dates=(), values=())


def adjustment(bars, events):
    """factor(t): product of (previous close - cash) / previous close over the code's later events."""
    e = asof.asof(events, bars.select("code", "date", "close"), ["close"], strict=True).where("close > cash").select("code", "date", ((F.col("close") - F.col("cash")) / F.col("close")).alias("m"))
    lg = e.select("code", "date", F.ln("m").alias("_l"), F.lit(1).alias("_e"))
    both = lg.unionByName(bars.select("code", "date", F.lit(0.0).alias("_l"), F.lit(0).alias("_e")))
    w = Window.partitionBy("code").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")).desc()).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("factor", F.exp(F.coalesce(F.sum("_l").over(w), F.lit(0.0)))).where("_e = 0").select("code", "date", "factor")


_MULT = "e AS (SELECT a.code, a.date, (b.close - a.cash) / b.close AS m FROM actions a ASOF JOIN bars b ON a.code = b.code AND a.date > b.date WHERE b.close > a.cash)"
C.add("CA_01_adjustment", lambda s, d: adjustment(B(s, d), X.actions(s, d)), f"{_MULT}\nSELECT b.code, b.date, exp(coalesce(sum(ln(e.m)), 0)) AS factor FROM bars b LEFT JOIN e ON e.code = b.code AND e.date > b.date GROUP BY 1, 2", values=("factor",))
C.add("CA_03_audit", lambda s, d: adjustment(B(s, d), X.actions(s, d)).groupBy("code").agg((F.max("factor") <= 1 + 1e-9).alias("bounded"), (F.max("factor") > F.min("factor")).alias("varies")), f"{_MULT},\nf AS (SELECT b.code, b.date, exp(coalesce(sum(ln(e.m)), 0)) AS factor FROM bars b LEFT JOIN e ON e.code = b.code AND e.date > b.date GROUP BY 1, 2)\nSELECT code, max(factor) <= 1 + 1e-9 AS bounded, max(factor) > min(factor) AS varies FROM f GROUP BY 1", dates=(), values=())
C.add("CA_05_total_return", lambda s, d: B(s, d).join(adjustment(B(s, d), X.actions(s, d)), ["code", "date"]).withColumn("tr", F.col("close") * F.col("factor")).select("code", "date", (ts.lead("tr", 4) / F.col("tr") - 1).alias("value")), f"{_MULT},\nf AS (SELECT b.code, b.date, any_value(b.close) * exp(coalesce(sum(ln(e.m)), 0)) AS tr FROM bars b LEFT JOIN e ON e.code = b.code AND e.date > b.date GROUP BY 1, 2)\nSELECT code, date, lead(tr, 4) OVER (PARTITION BY code ORDER BY date) / tr - 1 AS value FROM f")

# Events
C.add("ES_01_events", lambda s, d: panel.returns(B(s, d)).withColumn("i", F.row_number().over(ts.along())).where("abs(ret) >= 0.07 and vol >= 50 and i >= 60").select("code", "date", F.when(F.col("ret") > 0, "up").otherwise("down").alias("side")), "SELECT code, date, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS side FROM (SELECT *, close / lag(close) OVER v - 1 AS ret, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)) WHERE abs(ret) >= 0.07 AND vol >= 50 AND i >= 60", values=())


def _car(s, d, k: int = 4):
    """Mean market-adjusted return at bar offsets -k..k around an action, from bar numbers."""
    b = panel.returns(B(s, d)).withColumn("i", F.row_number().over(ts.along()))
    b = b.withColumn("x", F.col("ret") - F.avg("ret").over(xs.section())).where("x is not null")
    e = b.join(X.actions(s, d).select("code", "date"), ["code", "date"]).select("code", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("k"), F.col("i").alias("i0")).withColumn("i", F.col("i0") + F.col("k"))
    m = e.join(b.select("code", "i", "x"), ["code", "i"]).groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return m.withColumn("car", F.sum("mean").over(Window.orderBy("k")))


C.add("ES_09_car", _car, """b AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS x FROM (SELECT code, date, close / lag(close) OVER v - 1 AS ret, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date))),
y AS (SELECT * FROM b WHERE x IS NOT NULL), e AS (SELECT y.code, y.i AS i0, k FROM y SEMI JOIN actions USING (code, date) CROSS JOIN range(-4, 5) r(k)),
m AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS n, avg(x) AS mean FROM e JOIN y ON y.code = e.code AND y.i = e.i0 + k GROUP BY 1)
SELECT *, sum(mean) OVER (ORDER BY k) AS car FROM m""", dates=(), values=("mean", "car"))
C.add("ES_04_groups", lambda s, d: panel.forward_returns(panel.returns(B(s, d)), (4,)).where("ret is not null and fwd_4 is not null").withColumn("g", F.col("ret") > 0).groupBy("g").agg(F.count("*").alias("n"), F.avg("fwd_4").alias("mean"), (F.avg("fwd_4") / (F.stddev_samp("fwd_4") / F.sqrt(F.count("*")))).alias("t"), F.avg((F.col("fwd_4") > 0).cast("double")).alias("win")), "SELECT ret > 0 AS g, count(*) AS n, avg(f) AS mean, avg(f) / (stddev_samp(f) / sqrt(count(*))) AS t, avg(CAST(f > 0 AS INTEGER)) AS win FROM (SELECT close / lag(close) OVER v - 1 AS ret, lead(close, 4) OVER v / close - 1 AS f FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)) WHERE ret IS NOT NULL AND f IS NOT NULL GROUP BY 1", dates=(), values=("mean", "t", "win"))
C.add("ES_07_from_peak", lambda s, d: B(s, d).withColumn("pk", ts.last_known(F.when(F.col("vol") == ts.high("vol", 20, 1), F.col("close")))).select("code", "date", (F.col("close") / F.col("pk") - 1).alias("value")), "SELECT code, date, close / last_value(CASE WHEN vol = m THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS value FROM (SELECT *, max(vol) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING) AS m FROM bars)")

# Quality
C.add("DQ_01_complete", lambda s, d: B(s, d).groupBy("date").agg(F.countDistinct("code").alias("n")).where(F.col("n") >= 80).agg(F.max("date").alias("date")), "SELECT max(date) AS date FROM (SELECT date, count(DISTINCT code) AS n FROM bars GROUP BY 1) WHERE n >= 80", values=())
C.add("DQ_03_bounds", lambda s, d: X.table(s, d, "supplier").agg(F.count(F.when(F.col("s_acctbal") <= 0, 1)).alias("negative"), F.count("*").alias("n")), "SELECT count(*) FILTER (WHERE s_acctbal <= 0) AS negative, count(*) AS n FROM supplier", dates=(), values=())
C.add("DQ_04_second_source", lambda s, d: B(s, d).join(X.flow(s, d), ["code", "date"]).where(F.abs(F.col("main_net") / F.col("amount") - 1) > 0.02).groupBy("code").agg(F.count("*").alias("n")), "SELECT code, count(*) AS n FROM bars JOIN flow USING (code, date) WHERE abs(main_net / amount - 1) > 0.02 GROUP BY 1", dates=(), values=())
C.add("DQ_06_invariants", lambda s, d: B(s, d).agg(F.count(F.when(F.col("high") < F.col("low"), 1)).alias("crossed"), F.count(F.when(F.col("close") > F.col("high") * (1 + 1e-9), 1)).alias("above")), "SELECT count(*) FILTER (WHERE high < low) AS crossed, count(*) FILTER (WHERE close > high * (1 + 1e-9)) AS above FROM bars", dates=(), values=())
C.add("DQ_07_alignment", lambda s, d: B(s, d).select("code", "date", F.lit(1).alias("a")).join(X.actions(s, d).select("code", "date", F.lit(1).alias("b")), ["code", "date"], "full").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b")), "SELECT count(*) FILTER (WHERE a.code IS NULL OR b.code IS NULL) AS only_a, CAST(0 AS BIGINT) AS only_b FROM bars a FULL JOIN actions b ON a.code = b.code AND a.date = b.date", dates=(), values=())
C.add("DQ_08_duplicates", lambda s, d: X.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count("*").alias("keys"), F.sum("count").alias("rows")), "SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", dates=(), values=())
C.add("DQ_10_missing_days", lambda s, d: panel.dense(B(s, d).select("code", "date", "close")).where("close is null").groupBy("code").agg(F.count("*").alias("missing")), "SELECT code, count(*) AS missing FROM (SELECT code, date FROM (SELECT DISTINCT code FROM bars) CROSS JOIN (SELECT DISTINCT date FROM bars)) ANTI JOIN bars USING (code, date) GROUP BY 1", dates=(), values=())
C.add("DQ_11_depth", lambda s, d: B(s, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.max("date").alias("last")), "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(DISTINCT code) AS codes, count(DISTINCT date) AS days, min(date) AS first, max(date) AS last FROM bars GROUP BY 1", dates=("first", "last"), values=())

# Streams: a file source read to its end must give the batch result
# Which events a stream of the five parts lets in, by the latest time of two parts before
ON_TIME = """WITH parts AS (SELECT *, least((day(ts) - 1) // 10, 2) + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS part FROM events),
marks AS (SELECT p.part, (SELECT max(ts) FROM parts q WHERE q.part <= p.part - 2) - INTERVAL 10 MINUTES AS mark FROM (SELECT DISTINCT part FROM parts) p),
timed AS (SELECT parts.*, mark FROM parts JOIN marks USING (part))
"""
BAR = "time_bucket(INTERVAL 5 MINUTES, ts)"
C.add("SS_01_tumbling", stream.tumbling, ON_TIME + f", n AS (SELECT * FROM timed WHERE mark IS NULL OR {BAR} + INTERVAL 5 MINUTES > mark) SELECT event_type AS code, strftime({BAR}, '%Y-%m-%d %H:%M') AS start, max(value) AS high, min(value) AS low, CAST(count(*) + sum(user_id % 7) AS DOUBLE) AS vol FROM n GROUP BY 1, 2", dates=(), values=("high", "low"))
C.add("SS_05_enriched", stream.enriched, "SELECT event_type AS code, r_name AS region, count(*) AS n FROM events JOIN region ON user_id % 5 = r_regionkey GROUP BY 1, 2", dates=(), values=())
C.add("SS_03_deduplicated", stream.deduplicated, "SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1", dates=(), values=())
C.add("SS_03_upserted", lambda s, d: stream.revised(s, d).select(F.col("event_type").alias("code"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.col("close").alias("value"), "n"), """WITH m AS (SELECT event_type AS code, date_trunc('minute', ts) AS t, round(avg(value), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2)
SELECT code, strftime(t, '%Y-%m-%d %H:%M') AS minute, close + CASE WHEN minute(t) % 10 = 3 AND hour(t) % 2 = 0 THEN 1 ELSE 0 END AS value, n FROM m""", dates=())

C.add("MIN_log_range", lambda s, d: M(s, d).select("code", "date", "datetime", guarded_log(safe_div(F.col("high"), F.col("low"))).alias("value")).groupBy("code", "date").agg(F.avg("value").alias("value")), "SELECT code, date, avg(CASE WHEN high / nullif(low, 0) > 0 THEN ln(high / nullif(low, 0)) END) AS value FROM minutes GROUP BY 1, 2")

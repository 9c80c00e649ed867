"""Operators with state, small solvers, pools and payoffs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.books import held
from panelwright.catalog.judging import SQL as JUDGING
from panelwright.catalog.judging import factors, joined
from panelwright.operators import asof, kernels, panel, ts, xs
from panelwright.plans import evaluate as ev

C = X.Catalog()
B = X.bars
M = X.minutes


C.add("MIN_10_follow", lambda s, d: M(s, d).where("vol > 0").select("code", "date", "datetime", "vol").groupBy("code", "date").applyInPandas(kernels.spaced_followers, "code string, date date, n long, value double"))


def _day_regression(s, d, lags: int = 2):
    """Slopes of the minute return on lagged volume changes, by code and date, from one row of cross products each."""
    w = Window.partitionBy("code", "date").orderBy("datetime")
    m = M(s, d).where("close > 0").withColumns({"y": F.ln(F.col("close") / F.lag("close").over(w)), "v": F.col("vol") - F.lag("vol").over(w)})
    m = m.withColumns({f"x{k}": F.lag("v", k).over(w) for k in range(1, lags + 1)}).withColumn("g", F.concat_ws("|", "code", "date"))
    fit = xs.residual_many(m, "y", [f"x{k}" for k in range(1, lags + 1)], "e", least=10, by="g")
    return fit.where("e is not null").groupBy("code", "date").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("value"))


C.add("MIN_13_day_regression", _day_regression, """w AS (SELECT code, date, datetime, ln(close / lag(close) OVER v) AS y, vol - lag(vol) OVER v AS dv FROM minutes WHERE close > 0 WINDOW v AS (PARTITION BY code, date ORDER BY datetime)),
x AS (SELECT code, date, y, lag(dv, 1) OVER v AS a, lag(dv, 2) OVER v AS b FROM w WINDOW v AS (PARTITION BY code, date ORDER BY datetime)),
u AS (SELECT * FROM x WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT code, date, count(*) AS n, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM u GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT code, date, n, sqrt(greatest(yy - (bb * ay - ab * byy) / (aa * bb - ab * ab) * ay - (aa * byy - ab * ay) / (aa * bb - ab * ab) * byy, 0)) AS value FROM m""")


def _box_cox(s, d):
    """The power whose transformed volumes are most nearly normal, from a grid, by code and date."""
    grid = F.array(*[F.lit(x / 4) for x in range(-4, 9)])
    m = M(s, d).where("vol > 0").withColumn("l", F.explode(grid))
    m = m.withColumn("t", F.when(F.col("l") == 0, F.ln("vol")).otherwise((F.pow("vol", F.col("l")) - 1) / F.col("l")))
    a = m.groupBy("code", "date", "l").agg(F.count("*").alias("n"), F.var_pop("t").alias("v"), F.sum(F.ln("vol")).alias("s")).where("n >= 20 and v > 0")
    a = a.withColumn("ll", F.round(-F.col("n") / 2 * F.ln("v") + (F.col("l") - 1) * F.col("s"), 6))
    return a.groupBy("code", "date").agg(F.max_by("l", F.struct("ll", "l")).alias("value"))


C.add("MIN_14_box_cox", _box_cox, """t AS (SELECT code, date, l / 4.0 AS l, vol, CASE WHEN l = 0 THEN ln(vol) ELSE (pow(vol, l / 4.0) - 1) / (l / 4.0) END AS t FROM minutes CROSS JOIN range(-4, 9) r(l) WHERE vol > 0),
a AS (SELECT code, date, l, round(-count(*) / 2.0 * ln(var_pop(t)) + (l - 1) * sum(ln(vol)), 6) AS ll FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND var_pop(t) > 0)
SELECT code, date, arg_max(l, (ll, l)) AS value FROM a GROUP BY 1, 2""")
C.oracle["MIN_14_box_cox"] = C.oracle["MIN_14_box_cox"].replace("arg_max(l, (ll, l)) AS value FROM a GROUP BY 1, 2", "l AS value FROM a QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY ll DESC, l DESC) = 1")


C.add("PF_13_transfer", lambda s, d: factors(s, d).where("factor = 'size' and value is not null").withColumn("w", F.greatest(F.lit(0.0), F.col("value") - F.avg("value").over(xs.section()))).withColumns({"a": xs.rank("value"), "b": xs.rank("w")}).groupBy("date").agg(ev.corr_if_varied("a", "b").alias("value")), JUDGING + """, w AS (SELECT date, value, greatest(0, value - avg(value) OVER (PARTITION BY date)) AS w FROM factors WHERE factor = 'size' AND value IS NOT NULL),
r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY value) AS a, rank() OVER (PARTITION BY date ORDER BY w) AS b FROM w) SELECT date, corr(a, b) AS value FROM r GROUP BY 1""")


def _calendar_events(s, d, hold: int = 3):
    """Mean return per date of all events opened on the `hold` rows before."""
    b = panel.returns(B(s, d)).withColumns({"i": F.row_number().over(ts.along()), "hit": F.col("vol") > 80})
    open_ = b.where("hit").select("code", F.explode(F.sequence(F.col("i") + 1, F.col("i") + hold)).alias("i"))
    return open_.join(b.select("code", "i", "date", "ret"), ["code", "i"]).groupBy("date").agg(F.count("*").alias("n"), F.avg("ret").alias("value"))


C.add("PF_23_event_book", _calendar_events, """b AS (SELECT code, date, vol, close / lag(close) OVER v - 1 AS ret, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
o AS (SELECT code, i + k AS i FROM b CROSS JOIN range(1, 4) r(k) WHERE vol > 80)
SELECT date, count(*) AS n, avg(ret) AS value FROM o JOIN b USING (code, i) GROUP BY 1""")
C.add("PF_22_half_roll", lambda s, d: panel.returns(B(s, d)).groupBy("date").agg(F.avg("overnight").alias("g"), F.avg("intraday").alias("i")).withColumn("g0", F.lag("g").over(Window.orderBy("date"))).select("date", (0.5 * ((1 + F.col("g0")) * (1 + F.col("i")) - 1) + 0.5 * F.col("i")).alias("value")), """r AS (SELECT date, open / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS o, close / open - 1 AS i FROM bars), m AS (SELECT date, avg(o) AS g, avg(i) AS i FROM r GROUP BY 1)
SELECT date, 0.5 * ((1 + lag(g) OVER (ORDER BY date)) * (1 + i) - 1) + 0.5 * i AS value FROM m""")


def _pool_ic(s, d):
    """Rank IC inside a pool that is known as of its month."""
    m = B(s, d).groupBy(F.trunc("date", "month").alias("month"), "code").agg(F.sum("amount").alias("a"))
    pool = m.withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("a"), "code"))).where("r <= 60").select(F.add_months("month", 1).alias("month"), "code")
    j = joined(s, d, (4,)).withColumn("month", F.trunc("date", "month")).join(pool, ["month", "code"], "left_semi")
    return ev.daily_ic(j, (4,)).select("factor", "date", "n", F.col("rank_ic").alias("value"))


C.add("MS_04_pool_ic", _pool_ic, JUDGING + """, mm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, sum(amount) AS a FROM bars GROUP BY 1, 2),
pool AS (SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS month, code FROM mm QUALIFY row_number() OVER (PARTITION BY month ORDER BY a DESC, code) <= 60),
j AS (SELECT factor, joined.date, joined.code, value, fwd_4 FROM joined JOIN pool ON pool.code = joined.code AND pool.month = CAST(date_trunc('month', joined.date) AS DATE) WHERE value IS NOT NULL AND fwd_4 IS NOT NULL),
r AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY value) AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd_4) AS b FROM j)
SELECT factor, date, count(*) AS n, corr(a, b) AS value FROM r GROUP BY 1, 2 HAVING count(*) >= 30""")


def _clustered(s, d):
    """Clusters of seven factors, some of them near copies."""
    b = panel.returns(B(s, d))
    cols = {"mom_4": ts.change("close", 4), "mom_5": ts.change("close", 5), "mom_12": ts.change("close", 12), "vol_12": F.round(ts.std("ret", 12, 6), 9), "vol_14": F.round(ts.std("ret", 14, 6), 9), "amount": F.col("amount"), "volume": F.col("vol")}
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"_{n}").alias("value")) for n in cols]))
    f = b.withColumns({f"_{n}": c for n, c in cols.items()}).select("date", "code", long.alias("x")).select("date", "code", "x.factor", "x.value")
    return ev.clusters(ev.pairwise(f), f)


C.add("MS_10_clusters", _clustered, """rt AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
w AS (SELECT date, code, close / lag(close, 4) OVER v - 1 AS mom_4, close / lag(close, 5) OVER v - 1 AS mom_5, close / lag(close, 12) OVER v - 1 AS mom_12, round(CASE WHEN count(ret) OVER (v ROWS 11 PRECEDING) >= 6 THEN stddev_samp(ret) OVER (v ROWS 11 PRECEDING) END, 9) AS vol_12, round(CASE WHEN count(ret) OVER (v ROWS 13 PRECEDING) >= 6 THEN stddev_samp(ret) OVER (v ROWS 13 PRECEDING) END, 9) AS vol_14, amount, vol AS volume FROM rt WINDOW v AS (PARTITION BY code ORDER BY date)),
f AS (UNPIVOT w ON mom_4, mom_5, mom_12, vol_12, vol_14, amount, volume INTO NAME factor VALUE value),
j AS (SELECT x.factor AS a, y.factor AS b, date, rank() OVER (PARTITION BY x.factor, y.factor, date ORDER BY x.value) AS ra, rank() OVER (PARTITION BY x.factor, y.factor, date ORDER BY y.value) AS rb FROM f x JOIN f y USING (date, code) WHERE x.factor < y.factor),
c AS (SELECT a, b, avg(rho) AS rho FROM (SELECT a, b, date, corr(ra, rb) AS rho FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 30) GROUP BY 1, 2),
e AS (SELECT a, b, abs(rho) AS r FROM c UNION ALL SELECT b, a, abs(rho) FROM c), n AS (SELECT DISTINCT factor FROM f),
g AS (SELECT factor AS x, factor AS y FROM n UNION SELECT g.x, e.b FROM g JOIN e ON e.a = g.y WHERE e.r >= 0.7),
l AS (SELECT x AS factor, min(y) AS cluster FROM g GROUP BY 1),
m AS (SELECT e.a AS factor, avg(e.r) AS r FROM e JOIN l p ON p.factor = e.a JOIN l q ON q.factor = e.b WHERE p.cluster = q.cluster GROUP BY 1)
SELECT factor, cluster, count(*) OVER (PARTITION BY cluster) AS size, first_value(factor) OVER (PARTITION BY cluster ORDER BY round(coalesce(r, 0), 9) DESC, factor) AS medoid FROM l LEFT JOIN m USING (factor)""", dates=(), values=())
C.oracle["MS_10_clusters"] = C.oracle["MS_10_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)
C.add("UNI_07_one_group", lambda s, d: X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderpriority")).alias("board")), "SELECT o_custkey AS code, o_orderpriority AS board FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority) = 1", dates=(), values=())
C.add("CA_02_ex_gap", lambda s, d: asof.asof(X.actions(s, d).join(B(s, d).select("code", "date", "open"), ["code", "date"]), B(s, d).select("code", "date", "close"), ["close"], strict=True).select("code", "date", (F.col("open") / (F.col("close") - F.col("cash")) - 1).alias("value")), "SELECT a.code, a.date, o.open / (b.close - a.cash) - 1 AS value FROM (SELECT actions.code, actions.date, cash, open FROM actions JOIN bars USING (code, date)) a JOIN bars o ON o.code = a.code AND o.date = a.date ASOF LEFT JOIN bars b ON a.code = b.code AND a.date > b.date")


def _payoffs(s, d):
    """Mean return from `a` rows before to `b` rows after each action, for several windows."""
    b = B(s, d).withColumn("i", F.row_number().over(ts.along())).select("code", "date", "i", "close")
    e = b.join(X.actions(s, d).select("code", "date"), ["code", "date"]).select("code", F.col("i").alias("i0"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in ((-4, -1), (-1, 4), (0, 12))])).alias("w"))
    j = e.select("code", "i0", "w.a", "w.z").withColumns({"i": F.col("i0") + F.col("a"), "k": F.col("i0") + F.col("z")})
    j = j.join(b.select("code", "i", F.col("close").alias("c0")), ["code", "i"]).join(b.select("code", F.col("i").alias("k"), F.col("close").alias("c1")), ["code", "k"])
    return j.groupBy("a", "z").agg(F.count("*").alias("n"), F.avg(F.col("c1") / F.col("c0") - 1).alias("value"))


C.add("CA_04_payoffs", _payoffs, """b AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars), e AS (SELECT b.code, b.i AS i0, a, z FROM b SEMI JOIN actions USING (code, date) CROSS JOIN (VALUES (-4, -1), (-1, 4), (0, 12)) w(a, z))
SELECT a, z, count(*) AS n, avg(y.close / x.close - 1) AS value FROM e JOIN b x ON x.code = e.code AND x.i = i0 + a JOIN b y ON y.code = e.code AND y.i = i0 + z GROUP BY 1, 2""", dates=())


def _indicator(s, d):
    """Rank correlation of a market indicator with the next four rows' market return, on every row and on blocks apart."""
    m = panel.returns(B(s, d)).groupBy("date").agg(F.avg("ret").alias("r"), F.sum("amount").alias("a"))
    w = Window.orderBy("date")
    m = m.withColumns({"f": F.sum("r").over(w.rowsBetween(1, 4)), "n": F.count("r").over(w.rowsBetween(1, 4)), "i": F.row_number().over(w) - 1}).where("n = 4")
    both = m.withColumn("every", F.lit(1)).unionByName(m.where("i % 4 = 0").withColumn("every", F.lit(4)))
    k = Window.partitionBy("every")
    both = both.withColumns({"ra": F.rank().over(k.orderBy("a")), "rf": F.rank().over(k.orderBy(F.round("f", 9)))})
    return both.groupBy("every").agg(F.count("*").alias("n"), F.corr("ra", "rf").alias("value"))


C.add("ES_08_indicator", _indicator, """r AS (SELECT date, amount, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars), m AS (SELECT date, avg(ret) AS r, sum(amount) AS a FROM r GROUP BY 1),
f AS (SELECT *, sum(r) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f, count(r) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n, row_number() OVER (ORDER BY date) - 1 AS i FROM m),
u AS (SELECT *, 1 AS every FROM f WHERE n = 4 UNION ALL SELECT *, 4 FROM f WHERE n = 4 AND i % 4 = 0), k AS (SELECT every, rank() OVER (PARTITION BY every ORDER BY a) AS ra, rank() OVER (PARTITION BY every ORDER BY round(f, 9)) AS rf FROM u)
SELECT every, count(*) AS n, corr(ra, rf) AS value FROM k GROUP BY 1""", dates=())


def _booking(s, d):
    """How often the next-day booking of reports shows another value than the same-day one."""
    r = panel.latest(X.reports(s, d), ["code", "notice"], [F.desc("period")])
    b = B(s, d).select("code", "date")
    same = asof.asof(b, r, ["revenue"], right_on="notice").withColumnRenamed("revenue", "a")
    after = asof.asof(same, r, ["revenue"], right_on="notice", strict=True)
    return after.agg(F.count("*").alias("n"), F.count(F.when(~F.col("a").eqNullSafe(F.col("revenue")), 1)).alias("other"))


C.add("PIT_11_booking", _booking, """ladder AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1),
a AS (SELECT b.code, b.date, l.revenue AS x FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.notice), z AS (SELECT b.code, b.date, l.revenue AS y FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date > l.notice)
SELECT count(*) AS n, count(*) FILTER (WHERE x IS DISTINCT FROM y) AS other FROM a JOIN z USING (code, date)""", dates=(), values=())

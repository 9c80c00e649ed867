"""Further portfolio, universe, event and quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.books import BAR, HELD, ON_TIME, PERIODS, TURNOVER, _periods, _turnover, held
from panelwright.catalog.judging import SQL as JUDGING
from panelwright.catalog.judging import factors, features, ic, joined
from panelwright.operators import panel, ts, xs
from panelwright.plans import evaluate as ev
from panelwright.streaming import bars as stream

C = X.Catalog()
B = X.bars


def _weight_turnover(s, d):
    """Half the sum of weight changes over the names held now."""
    h = held(s, d).join(B(s, d).select("date", "code", "amount"), ["date", "code"])
    h = h.withColumn("w", F.col("amount") / F.sum("amount").over(Window.partitionBy("date")))
    k = h.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    h = h.join(F.broadcast(k), "date")
    old = h.select((F.col("k") + 1).alias("k"), "code", F.col("w").alias("w0"))
    return h.join(old, ["k", "code"], "left").groupBy("date").agg((F.sum(F.abs(F.col("w") - F.coalesce("w0", F.lit(0.0)))) / 2).alias("value"))


C.add("PF_05_weight_turnover", _weight_turnover, HELD + """, hw AS (SELECT date, code, amount / sum(amount) OVER (PARTITION BY date) AS w FROM held JOIN bars USING (date, code)),
x AS (SELECT hw.*, k FROM hw JOIN p USING (date))
SELECT a.date, sum(abs(a.w - coalesce(b.w, 0))) / 2 AS value FROM x a LEFT JOIN x b ON a.code = b.code AND b.k = a.k - 1 GROUP BY 1""")
C.add("PF_08_excess", lambda s, d: _periods(s, d).join(panel.forward_returns(B(s, d), (4,)).groupBy("date").agg(F.avg("fwd_4").alias("bench")), "date").withColumn("x", F.col("ret") - F.col("bench")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.avg("x") / F.stddev_samp("x")).alias("ir"), F.avg((F.col("x") > 0).cast("double")).alias("win")), PERIODS + """, fb AS (SELECT date, avg(f) AS bench FROM (SELECT date, lead(close, 4) OVER (PARTITION BY code ORDER BY date) / close - 1 AS f FROM bars) GROUP BY date)
SELECT count(ret - bench) AS n, avg(ret - bench) AS mean, avg(ret - bench) / stddev_samp(ret - bench) AS ir, avg(CAST(ret - bench > 0 AS INTEGER)) AS win FROM periods JOIN fb USING (date)""", dates=(), values=("mean", "ir", "win"))


def _phases(s, d):
    """Mean size of the first bucket's change over four rebalance grids, each starting one date later, in one job."""
    b = B(s, d)
    days = b.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("phase", F.col("i") % 4)
    f = panel.forward_returns(b, (4,)).join(F.broadcast(days), "date").where("fwd_4 is not null")
    t = f.withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("amount"), "code"))).where("r <= 10")
    return t.groupBy("phase", "date").agg(F.avg("fwd_4").alias("r")).groupBy("phase").agg(F.count("*").alias("n"), F.avg("r").alias("value"))


C.add("PF_10_phases", _phases, """i AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) % 4 AS phase FROM (SELECT DISTINCT date FROM bars)),
f AS (SELECT b.date, code, amount, phase, lead(close, 4) OVER (PARTITION BY code ORDER BY b.date) / close - 1 AS f FROM bars b JOIN i ON i.date = b.date),
t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM f WHERE f IS NOT NULL),
m AS (SELECT phase, date, avg(f) AS r FROM t WHERE r <= 10 GROUP BY 1, 2) SELECT CAST(phase AS INTEGER) AS phase, count(*) AS n, avg(r) AS value FROM m GROUP BY 1""", dates=())


C.add("PF_20_break_even", lambda s, d: _periods(s, d).join(_turnover(s, d), "date").agg((F.avg("ret") / F.avg("turnover")).alias("value")), PERIODS + TURNOVER + "SELECT avg(ret) / avg(turnover) AS value FROM periods JOIN tv USING (date)", dates=())
C.add("PF_24_flow_rule", lambda s, d: X.flow(s, d).groupBy("date").agg(F.sum("main_net").alias("net")).withColumn("m", F.avg("net").over(Window.orderBy("date").rowsBetween(-19, 0))).select("date", F.when(F.lag("m").over(Window.orderBy("date")) < 0, 0.5).otherwise(1.0).alias("value")), """m AS (SELECT date, avg(net) OVER (ORDER BY date ROWS 19 PRECEDING) AS m FROM (SELECT date, sum(main_net) AS net FROM flow GROUP BY date))
SELECT date, CASE WHEN lag(m) OVER (ORDER BY date) < 0 THEN 0.5 ELSE 1.0 END AS value FROM m""")
C.add("PF_28_cohorts", lambda s, d: ev.newey_west(joined(s, d, (4,)).where("value is not null and fwd_4 is not null").withColumn("q", xs.ntile("value", 5, ("factor", "date"))).withColumn("m", F.avg("fwd_4").over(Window.partitionBy("factor", "date"))).where("q = 5").groupBy("factor", "date").agg(F.avg(F.col("fwd_4") - F.col("m")).alias("x")), "x", 4, "factor"), JUDGING + """, q AS (SELECT factor, date, fwd_4 - avg(fwd_4) OVER (PARTITION BY factor, date) AS e, ntile(5) OVER (PARTITION BY factor, date ORDER BY value, code) AS q FROM joined WHERE value IS NOT NULL AND fwd_4 IS NOT NULL),
s AS (SELECT factor, date, avg(e) AS x FROM q WHERE q = 5 GROUP BY 1, 2), e AS (SELECT *, x - avg(x) OVER (PARTITION BY factor) AS e FROM s),
l AS (SELECT *, lag(e, 1) OVER v AS l1, lag(e, 2) OVER v AS l2, lag(e, 3) OVER v AS l3, lag(e, 4) OVER v AS l4 FROM e WINDOW v AS (PARTITION BY factor ORDER BY date)),
z AS (SELECT factor, count(*) AS n, avg(x) AS mean, (sum(e * e) + 2 * (0.8 * sum(e * l1) + 0.6 * sum(e * l2) + 0.4 * sum(e * l3) + 0.2 * sum(e * l4))) / count(*) AS v FROM l GROUP BY 1)
SELECT factor, n, mean, CASE WHEN v > 0 THEN mean / sqrt(v / n) END AS t FROM z""", dates=(), values=("mean", "t"))


def _dated_pool(s, d):
    """Per date the codes that trade that day and were first seen 140 days before it."""
    b = B(s, d).withColumn("first", F.min("date").over(Window.partitionBy("code")))
    return b.where(F.datediff("date", "first") >= 140).groupBy("date").agg(F.count("*").alias("n"))


C.add("UNI_02_dated_pool", _dated_pool, "SELECT date, count(*) AS n FROM (SELECT date, min(date) OVER (PARTITION BY code) AS first FROM bars) WHERE date_diff('day', first, date) >= 140 GROUP BY 1", values=())


def _overlap(s, d):
    """Agreement of two rankings' top halves, by month."""
    m = B(s, d).groupBy(F.trunc("date", "month").alias("month"), "code").agg(F.sum("amount").alias("a"), F.sum("vol").alias("v"))
    t = m.withColumns({"x": F.row_number().over(Window.partitionBy("month").orderBy(F.desc("a"), "code")) <= 30, "y": F.row_number().over(Window.partitionBy("month").orderBy(F.desc("v"), "code")) <= 30})
    return t.groupBy("month").agg((F.sum((F.col("x") & F.col("y")).cast("int")) / F.sum(F.col("x").cast("int"))).alias("value"))


C.add("UNI_04_overlap", _overlap, """m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, sum(amount) AS a, sum(vol) AS v FROM bars GROUP BY 1, 2),
t AS (SELECT month, row_number() OVER (PARTITION BY month ORDER BY a DESC, code) <= 30 AS x, row_number() OVER (PARTITION BY month ORDER BY v DESC, code) <= 30 AS y FROM m)
SELECT month, sum(CAST(x AND y AS INTEGER)) / sum(CAST(x AS INTEGER)) AS value FROM t GROUP BY 1""", dates=("month",))


def _dividend_pool(s, d):
    """Codes with cash in three years running, by mean yield."""
    y = X.actions(s, d).groupBy("code", F.year("date").alias("year")).agg(F.sum("cash").alias("cash"))
    p = B(s, d).groupBy("code", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("close"))
    j = y.join(p, ["code", "year"]).withColumn("yield", F.col("cash") / F.col("close"))
    w = Window.partitionBy("code").orderBy("year").rangeBetween(-2, 0)
    j = j.withColumns({"n": F.count("*").over(w), "m": F.avg("yield").over(w)}).where("n = 3")
    return j.withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy(F.desc(F.round("m", 9)), "code"))).where("r <= 20").select("year", "code", F.col("m").alias("value"))


C.add("UNI_06_dividend_pool", _dividend_pool, """y AS (SELECT code, year(date) AS year, sum(cash) AS cash FROM actions GROUP BY 1, 2), p AS (SELECT code, year(date) AS year, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
j AS (SELECT code, CAST(year AS INTEGER) AS year, cash / close AS yl FROM y JOIN p USING (code, year)),
k AS (SELECT code, year, count(*) OVER w AS n, avg(yl) OVER w AS m FROM j WINDOW w AS (PARTITION BY code ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT year, code, m AS value FROM k WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(m, 9) DESC, code) <= 20""", dates=())
C.add("CA_06_multipliers", lambda s, d: X.actions(s, d).select("code", "date", ts.compounded(-F.col("cash") / 1000).alias("value")), "SELECT code, date, exp(sum(ln(1 - cash / 1000)) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)) AS value FROM actions")


def _deviation(s, d):
    """Three-row sum of the return over the market's beyond a bound, cooled down over three rows."""
    r = panel.returns(B(s, d))
    r = r.withColumn("x", F.col("ret") - F.percentile("ret", F.lit(0.5)).over(xs.section()))
    r = r.withColumn("dev", ts.total("x", 3)).withColumn("hit", F.coalesce(F.abs("dev") > 5, F.lit(False)))
    return ts.cooled_down(r, "hit", 3).where("kept").groupBy("code").agg(F.count("*").alias("n"))


C.add("ES_02_deviation", _deviation, None)


def _adjusted_windows(s, d):
    """Mean market-adjusted executable return after large moves, at several horizons."""
    b = panel.returns(B(s, d))
    for k in (1, 4, 12):
        b = b.withColumn(f"x{k}", panel.executable_return(k))
        b = b.withColumn(f"x{k}", F.col(f"x{k}") - F.avg(f"x{k}").over(xs.section()))
    return b.where("abs(ret) > 0.5").agg(*[F.avg(f"x{k}").alias(f"x{k}") for k in (1, 4, 12)], F.count("*").alias("n"))


_X = ", ".join(f"CASE WHEN NOT coalesce(lead(high) OVER v = lead(low) OVER v AND lead(close) OVER v / close - 1 >= 0.07, false) THEN lead(close, {k}) OVER v / lead(open) OVER v - 1 END AS e{k}" for k in (1, 4, 12))
C.add("ES_03_adjusted_windows", _adjusted_windows, f"""e AS (SELECT date, code, close / lag(close) OVER v - 1 AS ret, {_X} FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
m AS (SELECT ret, {", ".join(f"e{k} - avg(e{k}) OVER (PARTITION BY date) AS x{k}" for k in (1, 4, 12))} FROM e)
SELECT avg(x1) AS x1, avg(x4) AS x4, avg(x12) AS x12, count(*) AS n FROM m WHERE abs(ret) > 0.5""", dates=(), values=("x1", "x4", "x12"))


def _offsets(s, d, k: int = 3):
    """Share of large moves at each bar offset around the first bar on or after a publication."""
    b = panel.returns(B(s, d)).withColumns({"i": F.row_number().over(ts.along()), "spike": (F.abs("ret") > 0.5).cast("double")})
    n = X.reports(s, d).select("code", F.date_add(F.next_day(F.date_sub("notice", 1), "Mon"), 0).alias("date"))
    e = b.join(n, ["code", "date"]).select("code", F.col("i").alias("i0"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("k")).withColumn("i", F.col("i0") + F.col("k"))
    return e.join(b.select("code", "i", "spike"), ["code", "i"]).groupBy("k").agg(F.count("*").alias("n"), F.avg("spike").alias("value"))


C.add("ES_05_offsets", _offsets, """b AS (SELECT code, date, row_number() OVER v AS i, CAST(abs(close / lag(close) OVER v - 1) > 0.5 AS INTEGER) AS spike FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
n AS (SELECT code, CAST(CASE WHEN dayofweek(notice) = 1 THEN notice ELSE date_trunc('week', notice) + INTERVAL 7 DAY END AS DATE) AS date FROM reports),
e AS (SELECT b.code, b.i AS i0, k FROM b JOIN n USING (code, date) CROSS JOIN range(-3, 4) r(k))
SELECT CAST(k AS INTEGER) AS k, count(*) AS n, avg(spike) AS value FROM e JOIN b ON b.code = e.code AND b.i = e.i0 + k GROUP BY 1""", dates=())
C.add("ES_06_drawdown_inflow", lambda s, d: panel.returns(B(s, d)).join(X.flow(s, d), ["code", "date"]).withColumns({"r2": ts.change("close", 2), "top": ts.high("main_net", 20, 5)}).where("r2 <= -0.15 and main_net >= top").select("code", "date"), "SELECT code, date FROM (SELECT code, date, main_net, close / lag(close, 2) OVER v - 1 AS r2, CASE WHEN count(main_net) OVER (v ROWS 19 PRECEDING) >= 5 THEN max(main_net) OVER (v ROWS 19 PRECEDING) END AS top FROM bars JOIN flow USING (code, date) WINDOW v AS (PARTITION BY code ORDER BY date)) WHERE r2 <= -0.15 AND main_net >= top", values=())
C.add("DQ_02_freshness", lambda s, d: B(s, d).agg(F.max("date").alias("a")).join(X.reports(s, d).agg(F.max("notice").alias("b"))).select(F.datediff("a", "b").alias("behind"), (F.abs(F.datediff("a", "b")) <= 120).alias("ok")), "SELECT CAST(date_diff('day', b, a) AS INTEGER) AS behind, abs(date_diff('day', b, a)) <= 120 AS ok FROM (SELECT max(date) AS a FROM bars), (SELECT max(notice) AS b FROM reports)", dates=(), values=())
C.add("DQ_05_water_level", lambda s, d: ev.coverage(factors(s, d), B(s, d)).select("factor", "behind", "ok"), JUDGING + """, n AS (SELECT factor, date, count(*) AS n FROM factors WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS k, lead(n) OVER (PARTITION BY factor ORDER BY date DESC) AS before FROM n),
c AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS behind FROM (SELECT DISTINCT date FROM bars))
SELECT factor, behind, behind <= 1 AND n >= 0.9 * coalesce(before, n) AS ok FROM k JOIN c USING (date) WHERE k = 1""", dates=(), values=())
C.add("DQ_09_scale", lambda s, d: B(s, d).join(X.flow(s, d), ["code", "date"]).where("main_net > 0").select(F.lit(0).alias("all"), (F.col("main_net") / F.col("amount")).alias("x")).transform(xs.quantiles, "x", {"q5": 0.05, "q50": 0.5, "q95": 0.95}, "all").agg(*[F.max(q).alias(q) for q in ("q5", "q50", "q95")]), "SELECT quantile_cont(main_net / amount, 0.05) AS q5, quantile_cont(main_net / amount, 0.5) AS q50, quantile_cont(main_net / amount, 0.95) AS q95 FROM bars JOIN flow USING (code, date) WHERE main_net > 0", dates=(), values=("q5", "q50", "q95"))
C.add("DQ_12_grade", lambda s, d: ev.ic_summary(ic(s, d)).select("factor", "h", F.when((F.abs("mean") > 0.03) & (F.abs("icir") > 0.5), "pass").when((F.abs("mean") > 0.02) & (F.abs("icir") > 0.3), "watch").otherwise("weak").alias("grade")), JUDGING + "SELECT factor, CAST(h AS INTEGER) AS h, CASE WHEN abs(avg(rank_ic)) > 0.03 AND abs(avg(rank_ic) / stddev_samp(rank_ic)) > 0.5 THEN 'pass' WHEN abs(avg(rank_ic)) > 0.02 AND abs(avg(rank_ic) / stddev_samp(rank_ic)) > 0.3 THEN 'watch' ELSE 'weak' END AS grade FROM ic GROUP BY 1, 2", dates=(), values=())
C.add("PIT_12_states", lambda s, d: X.table(s, d, "part").select("p_partkey", F.when(F.col("p_name").like("%green%"), 2).when(F.col("p_name").like("%b%"), 1).otherwise(0).alias("state")), "SELECT p_partkey, CAST(CASE WHEN p_name LIKE '%green%' THEN 2 WHEN p_name LIKE '%b%' THEN 1 ELSE 0 END AS INTEGER) AS state FROM part", dates=(), values=())


def _complementary(s, d):
    """Two scores: mean section correlation, and the rank IC of each and of their mean."""
    wide = features(s, d, ("mom_4", "size")).withColumn("mean", (F.col("mom_4") + F.col("size")) / 2)
    long = wide.unpivot(["date", "code"], ["mom_4", "size", "mean"], "factor", "value").withColumn("value", F.round("value", 9))
    return ev.ic_summary(ev.daily_ic(ev.with_forward(long, B(s, d), (4,)), (4,))).select("factor", "days", F.col("mean").alias("value"))


C.add("EV_21_complementary", _complementary, JUDGING + """, r AS (SELECT date, code, factor, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY factor, date) AS r FROM factors WHERE value IS NOT NULL AND factor <> 'vol_12'),
p AS (SELECT date, code, max(r) FILTER (WHERE factor = 'mom_4') AS a, max(r) FILTER (WHERE factor = 'size') AS b FROM r GROUP BY 1, 2), q AS (SELECT *, (a + b) / 2 AS m FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
l AS (SELECT date, code, 'mom_4' AS factor, round(a, 9) AS value FROM q UNION ALL SELECT date, code, 'size', round(b, 9) FROM q UNION ALL SELECT date, code, 'mean', round(m, 9) FROM q),
k AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY value) AS rv, rank() OVER (PARTITION BY factor, date ORDER BY fwd_4) AS rf FROM l JOIN fwd USING (date, code) WHERE fwd_4 IS NOT NULL),
i AS (SELECT factor, date, corr(rv, rf) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT factor, count(ic) AS days, avg(ic) AS value FROM i GROUP BY 1""", dates=())
C.add("SS_02_sliding", lambda s, d: stream.appended_variance(s, X.table(s, d, "events")).select("code", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "variance"), ON_TIME + f", w AS (SELECT event_type AS code, {BAR} - k * INTERVAL 5 MINUTES AS start, value, mark FROM timed CROSS JOIN range(0, 6) t(k)) SELECT code, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, var_samp(value) AS variance FROM w WHERE mark IS NULL OR start + INTERVAL 30 MINUTES > mark GROUP BY 1, 2", dates=(), values=("variance",), digits=3)

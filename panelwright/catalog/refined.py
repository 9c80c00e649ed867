"""Fuller forms of portfolio, audit, payoff and minute rows, and SQL for queries that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog import rest
from panelwright.catalog.books import HELD, held
from panelwright.catalog.formulas import GRID, SQLS
from panelwright.catalog.judging import SQL as JUDGING
from panelwright.catalog.judging import factors, ic
from panelwright.operators import panel, ts, xs
from panelwright.plans import formulas

C = X.Catalog()
B = X.bars


# Exposure applied to a curve; the market has one row a date
def _timed_curve(s, d):
    """The market's mean return times the exposure set on the row before: half while the fast mean of its level is below the slow one; and the logarithm of what it has compounded to."""
    m = panel.returns(B(s, d)).groupBy("date").agg(F.avg("close").alias("m"), F.avg("ret").alias("r"))
    w = Window.orderBy("date")
    m = m.withColumn("e", F.when(F.avg("m").over(w.rowsBetween(-4, 0)) < F.avg("m").over(w.rowsBetween(-19, 0)), 0.5).otherwise(1.0))
    m = m.withColumn("exposure", F.coalesce(F.lag("e").over(w), F.lit(1.0))).withColumn("x", F.coalesce("r", F.lit(0.0)) * F.col("exposure"))
    return m.select("date", "exposure", F.sum(F.log1p("x")).over(w).alias("value"))


C.add("PF_17_timed_curve", _timed_curve, """m AS (SELECT date, avg(close) AS m, avg(r) AS r FROM (SELECT date, close, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM bars) GROUP BY 1),
e AS (SELECT *, CASE WHEN avg(m) OVER (ORDER BY date ROWS 4 PRECEDING) < avg(m) OVER (ORDER BY date ROWS 19 PRECEDING) THEN 0.5 ELSE 1.0 END AS e FROM m), x AS (SELECT date, coalesce(lag(e) OVER (ORDER BY date), 1.0) AS exposure, coalesce(r, 0) AS r FROM e)
SELECT date, exposure, sum(ln(1 + r * exposure)) OVER (ORDER BY date) AS value FROM x""", digits=3)


def _ic_rule(s, d):
    """Half exposure from the next row on while the mean of the 60 last ICs that had ended by then is below 0."""
    w = Window.partitionBy("factor").orderBy("date")
    i = ic(s, d).where("h = 4").withColumn("m", F.avg("rank_ic").over(w.rowsBetween(-63, -4)))
    return i.select("factor", "date", F.when(F.round(F.lag("m").over(w), 9) < 0, 0.5).otherwise(1.0).alias("value"))


C.add("PF_24_ic_rule", _ic_rule, JUDGING + ", k AS (SELECT factor, date, avg(rank_ic) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN 63 PRECEDING AND 4 PRECEDING) AS m FROM ic WHERE h = 4) SELECT factor, date, CASE WHEN round(lag(m) OVER (PARTITION BY factor ORDER BY date), 9) < 0 THEN 0.5 ELSE 1.0 END AS value FROM k")


def _grid(s, d):
    """Mean next return over a grid of names held, rows between rebalances, phases and weights, in one job: each row joins the settings that it belongs to."""
    b = panel.forward_returns(B(s, d), (2, 4))
    days = b.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    r = b.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("amount"), "code"))).where("rank <= 20").join(F.broadcast(days), "date")
    r = r.withColumn("n", F.explode(F.array(F.lit(10), F.lit(20)))).where("rank <= n").withColumn("step", F.explode(F.array(F.lit(2), F.lit(4)))).withColumn("weight", F.explode(F.array(F.lit("equal"), F.lit("amount"))))
    r = r.withColumns({"phase": (F.col("i") % F.col("step")).cast("int"), "f": F.when(F.col("step") == 2, F.col("fwd_2")).otherwise(F.col("fwd_4")), "w": F.when(F.col("weight") == "equal", 1.0).otherwise(F.col("amount"))}).where("f is not null")
    key = ("n", "step", "phase", "weight")
    return r.groupBy(*key, "date").agg((F.sum(F.col("w") * F.col("f")) / F.sum("w")).alias("x")).groupBy(*key).agg(F.count("*").alias("k"), F.avg("x").alias("value"))


C.add("PF_31_grid", _grid, """f AS (SELECT date, code, amount, lead(close, 2) OVER v / close - 1 AS f2, lead(close, 4) OVER v / close - 1 AS f4 FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), r AS (SELECT f.*, i, row_number() OVER (PARTITION BY f.date ORDER BY amount DESC, code) AS rank FROM f JOIN i ON i.date = f.date),
g AS (SELECT n, step, CAST(i % step AS INTEGER) AS phase, weight, date, CASE WHEN step = 2 THEN f2 ELSE f4 END AS f, CASE WHEN weight = 'equal' THEN 1.0 ELSE amount END AS w FROM r CROSS JOIN (VALUES (10), (20)) a(n) CROSS JOIN (VALUES (2), (4)) b(step) CROSS JOIN (VALUES ('equal'), ('amount')) c(weight) WHERE rank <= n),
m AS (SELECT n, step, phase, weight, date, sum(w * f) / sum(w) AS x FROM g WHERE f IS NOT NULL GROUP BY 1, 2, 3, 4, 5) SELECT n, step, phase, weight, count(*) AS k, avg(x) AS value FROM m GROUP BY 1, 2, 3, 4""", dates=())


def _drag(s, d):
    """A position's share of the mean amount of 12 rows: quantiles, how many pass 2 and 5 %, and the cost of a square-root impact of the deviation of returns."""
    b = panel.returns(B(s, d)).select("date", "code", ts.mean("amount", 12, 6).alias("adv"), ts.std("ret", 12, 6).alias("sd"))
    x = 1000 / F.col("adv")
    h = held(s, d).join(b, ["date", "code"])
    return h.groupBy("date").agg(*[F.percentile(x, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.5, 0.9)], *[F.count(F.when(x > t, 1)).alias(f"over_{int(t * 100)}") for t in (0.02, 0.05)], F.avg(F.col("sd") * F.sqrt(x)).alias("drag"))


C.add("PF_19_drag", _drag, HELD + """, a AS (SELECT date, code, CASE WHEN count(amount) OVER v >= 6 THEN avg(amount) OVER v END AS adv, CASE WHEN count(ret) OVER v >= 6 THEN stddev_samp(ret) OVER v END AS sd FROM o WINDOW v AS (PARTITION BY code ORDER BY date ROWS 11 PRECEDING)),
x AS (SELECT date, 1000 / adv AS x, sd FROM held JOIN a USING (date, code)) SELECT date, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.9) AS q90, count(*) FILTER (WHERE x > 0.02) AS over_2, count(*) FILTER (WHERE x > 0.05) AS over_5, avg(sd * sqrt(x)) AS drag FROM x GROUP BY 1""", values=("q50", "q90", "drag"))


def _orders(s, d):
    """From each rebalance to the next: what is bought and sold at a tenth a name."""
    h = held(s, d)
    days = h.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    k = h.join(F.broadcast(days), "date").select("i", "code", F.lit(0.1).alias("w"))
    both = k.select("i", "code", F.col("w").alias("target"), F.lit(0.0).alias("cur")).unionByName(k.select((F.col("i") + 1).alias("i"), "code", F.lit(0.0).alias("target"), F.col("w").alias("cur")))
    o = both.groupBy("i", "code").agg(F.sum("cur").alias("cur"), F.sum("target").alias("target")).withColumn("delta", F.col("target") - F.col("cur"))
    o = o.where((F.col("i") > 1) & (F.abs("delta") >= 0.005)).join(F.broadcast(days), "i")
    return o.select("date", "code", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), "cur", "target", "delta")


C.add("PF_16_all_orders", _orders, HELD + """, i AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM held)), k AS (SELECT i, code FROM held JOIN i USING (date)),
od AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 0.0 ELSE 0.1 END AS cur, CASE WHEN a.code IS NULL THEN 0.0 ELSE 0.1 END AS target FROM k a FULL JOIN k b ON a.code = b.code AND a.i = b.i + 1)
SELECT date, code, CASE WHEN target > cur THEN 'buy' ELSE 'sell' END AS side, cur, target, target - cur AS delta FROM od JOIN i USING (i) WHERE i > 1 AND target <> cur""", values=("cur", "target", "delta"))


# Structure of factor tables: two of them hold faults on purpose
def _faulty(s, d) -> DataFrame:
    f = factors(s, d)
    twice = f.where("factor = 'size' and code = '3'")
    broken = f.where("factor = 'mom_4'").withColumn("value", F.when(F.col("code") == "5", F.lit(float("inf"))).otherwise(F.col("value")))
    return f.where("factor <> 'mom_4'").unionByName(twice).unionByName(broken)


def audit(f: DataFrame) -> DataFrame:
    """Per factor: rows, repeated keys, nulls, infinite and non-zero values, quantiles of |value|, and the least and median number of names a day."""
    infinite = F.col("value").isNotNull() & (F.abs("value") == float("inf"))
    whole = f.groupBy("factor").agg(F.count("*").alias("rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"), F.count(F.when(infinite, 1)).alias("infinite"), F.avg((F.col("value") != 0).cast("double")).alias("nonzero"))
    sizes = xs.quantiles(f.select("factor", F.when(~infinite, F.abs("value")).alias("_size")), "_size", {"q01": 0.01, "q50": 0.5, "q99": 0.99}, "factor")
    keys = f.groupBy("factor", "date", "code").agg(F.count("*").alias("n"))
    days = keys.groupBy("factor", "date").agg(F.sum(F.col("n") - 1).alias("again"), F.count("*").alias("names"))
    days = days.groupBy("factor").agg(F.sum("again").alias("repeated"), F.min("names").alias("least_names"), F.percentile("names", F.lit(0.5)).alias("median_names"))
    return whole.join(sizes, "factor", "left").join(days, "factor").select("factor", "rows", "nulls", "infinite", "nonzero", "q01", "q50", "q99", "repeated", "least_names", "median_names")


C.add("PIT_09_audit", lambda s, d: audit(_faulty(s, d)), JUDGING + """, ff AS (SELECT * FROM factors WHERE factor <> 'mom_4' UNION ALL SELECT * FROM factors WHERE factor = 'size' AND code = '3' UNION ALL SELECT date, code, factor, CASE WHEN code = '5' THEN 'inf'::DOUBLE ELSE value END FROM factors WHERE factor = 'mom_4'),
w AS (SELECT factor, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE isinf(value)) AS infinite, avg(CAST(value <> 0 AS INTEGER)) AS nonzero, quantile_cont(abs(value), 0.01) FILTER (WHERE NOT isinf(value)) AS q01, quantile_cont(abs(value), 0.5) FILTER (WHERE NOT isinf(value)) AS q50, quantile_cont(abs(value), 0.99) FILTER (WHERE NOT isinf(value)) AS q99 FROM ff GROUP BY 1),
k AS (SELECT factor, date, sum(n - 1) AS again, count(*) AS names FROM (SELECT factor, date, code, count(*) AS n FROM ff GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT w.*, r.repeated, r.least_names, r.median_names FROM w JOIN (SELECT factor, CAST(sum(again) AS BIGINT) AS repeated, min(names) AS least_names, quantile_cont(names, 0.5) AS median_names FROM k GROUP BY 1) r USING (factor)""", dates=(), values=("nonzero", "q01", "q50", "q99", "median_names"))


def _taxed(s, d):
    """Mean payoff of buying `a` rows from each action and selling at `z`: price change and the cash, less 20 % of it up to 4 rows held, 10 % up to 52, none beyond."""
    b = B(s, d).withColumn("i", F.row_number().over(ts.along()))
    e = b.join(X.actions(s, d), ["code", "date"])
    price = b.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("i", "close"))).alias("at"))
    windows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in ((-10, -1), (-5, 4), (-5, 12), (-5, 60))])
    j = e.join(price, "code").select("cash", F.col("i").alias("i0"), "at", F.explode(windows).alias("w"))
    buy, sell = F.try_element_at("at", (F.col("i0") + F.col("w.a")).cast("int")), F.try_element_at("at", (F.col("i0") + F.col("w.z")).cast("int"))
    held_for = F.col("w.z") - F.col("w.a")
    rate = F.when(F.col("w.z") < 0, 1.0).when(held_for <= 4, 0.2).when(held_for <= 52, 0.1).otherwise(0.0)
    j = j.select("w.a", "w.z", buy.alias("buy"), sell.alias("sell"), "cash", rate.alias("rate")).where("buy is not null and sell is not null")
    return j.groupBy("a", "z").agg(F.count("*").alias("n"), F.avg((F.col("sell") + F.col("cash") * (1 - F.col("rate"))) / F.col("buy") - 1).alias("value"))


C.add("CA_04_taxed", _taxed, """b AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars), e AS (SELECT b.code, b.i AS i0, cash, a, z, CASE WHEN z < 0 THEN 1.0 WHEN z - a <= 4 THEN 0.2 WHEN z - a <= 52 THEN 0.1 ELSE 0.0 END AS rate FROM b JOIN actions USING (code, date) CROSS JOIN (VALUES (-10, -1), (-5, 4), (-5, 12), (-5, 60)) w(a, z))
SELECT a, z, count(*) AS n, avg((y.close + cash * (1 - rate)) / x.close - 1) AS value FROM e JOIN b x ON x.code = e.code AND x.i = i0 + a JOIN b y ON y.code = e.code AND y.i = i0 + z GROUP BY 1, 2""", dates=())


# Minutes
def _fairness(s, d, after: int = 5):
    """Per code and day: the power that makes volumes most nearly normal, and how differently prices move after surges and plunges of the transformed volume (beyond a deviation from its mean change), times the day's return."""
    w = Window.partitionBy("code", "date").orderBy("datetime")
    best = rest._box_cox(s, d).withColumnRenamed("value", "l")
    m = X.minutes(s, d).where("vol > 0 and close > 0").join(best, ["code", "date"])
    m = m.withColumn("t", F.when(F.col("l") == 0, F.ln("vol")).otherwise((F.pow("vol", F.col("l")) - 1) / F.col("l")))
    m = m.withColumns({"dv": F.lead("t").over(w) - F.col("t"), "r": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))})
    ahead, day = w.rowsBetween(0, after - 1), Window.partitionBy("code", "date")
    m = m.withColumns({"k": F.count("r").over(ahead), "sd": F.stddev_pop("r").over(ahead), "go": F.lead("close", after - 1).over(w) / F.col("close") - 1, "mu": F.avg("dv").over(day), "dsd": F.stddev_pop("dv").over(day)})
    gap = F.round(F.col("dv") - F.col("mu"), 9)
    m = m.withColumn("side", F.when(gap > F.round("dsd", 9), 1).when(gap < -F.round("dsd", 9), -1)).withColumn("side", F.when(F.col("k") == after, F.col("side")))
    of = lambda side, x: F.avg(F.when(F.col("side") == side, F.col(x)))
    whole = F.max_by("close", "datetime") / F.min_by("close", "datetime") - 1
    return m.groupBy("code", "date").agg(F.max("l").alias("power"), (F.abs(of(1, "sd") - of(-1, "sd")) * whole).alias("vol_fair"), (F.abs(of(1, "go") - of(-1, "go")) * whole).alias("ret_fair"))


C.add("MIN_14_fairness", _fairness, """bc AS (SELECT code, date, l / 4.0 AS l, vol, CASE WHEN l = 0 THEN ln(vol) ELSE (pow(vol, l / 4.0) - 1) / (l / 4.0) END AS t FROM minutes CROSS JOIN range(-4, 9) r(l) WHERE vol > 0),
ba AS (SELECT code, date, l, round(-count(*) / 2.0 * ln(var_pop(t)) + (l - 1) * sum(ln(vol)), 6) AS ll FROM bc GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND var_pop(t) > 0),
bb AS (SELECT code, date, l FROM ba QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY ll DESC, l DESC) = 1),
m AS (SELECT code, date, datetime, close, l, CASE WHEN l = 0 THEN ln(vol) ELSE (pow(vol, l) - 1) / l END AS t FROM minutes JOIN bb USING (code, date) WHERE vol > 0 AND close > 0),
n AS (SELECT *, lead(t) OVER w - t AS dv, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM m WINDOW w AS (PARTITION BY code, date ORDER BY datetime)),
o AS (SELECT *, count(r) OVER a AS k, stddev_pop(r) OVER a AS sd, lead(close, 4) OVER w / close - 1 AS go, avg(dv) OVER y AS mu, stddev_pop(dv) OVER y AS dsd FROM n WINDOW w AS (PARTITION BY code, date ORDER BY datetime), a AS (PARTITION BY code, date ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), y AS (PARTITION BY code, date)),
p AS (SELECT *, CASE WHEN k = 5 AND round(dv - mu, 9) > round(dsd, 9) THEN 1 WHEN k = 5 AND round(dv - mu, 9) < -round(dsd, 9) THEN -1 END AS side FROM o)
SELECT code, date, max(l) AS power, abs(avg(sd) FILTER (WHERE side = 1) - avg(sd) FILTER (WHERE side = -1)) * (arg_max(close, datetime) / arg_min(close, datetime) - 1) AS vol_fair, abs(avg(go) FILTER (WHERE side = 1) - avg(go) FILTER (WHERE side = -1)) * (arg_max(close, datetime) / arg_min(close, datetime) - 1) AS ret_fair FROM p GROUP BY 1, 2""", values=("power", "vol_fair", "ret_fair"), digits=3)


def lagged_regression(m: DataFrame, lags: int = 5, least: int = 20) -> DataFrame:
    """Per code and date of minutes: the slopes of the minute's return on `lags` earlier changes of volume and an intercept, their t values, and F.

    Spark sums each day's cross products, one row a day, and numpy solves them.
    """
    w = Window.partitionBy("code", "date").orderBy("datetime")
    d = m.where("close > 0").withColumns({"y": F.ln(F.col("close") / F.lag("close").over(w)), "v": F.col("vol") - F.lag("vol").over(w)})
    x = [f"x{k}" for k in range(1, lags + 1)]
    d = d.withColumns({f"x{k}": F.lag("v", k).over(w) for k in range(1, lags + 1)}).na.drop(subset=["y", *x])
    names = [F.lit(1.0), *[F.col(c) for c in x], F.col("y")]
    sums = [F.sum(names[i] * names[j]).cast("double").alias(f"s{i}_{j}") for i in range(lags + 2) for j in range(i, lags + 2)]
    moments = d.groupBy("code", "date").agg(*sums).where(F.col("s0_0") >= least)

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        p = lags + 1
        for batch in batches:
            out = [[], [], [], [], []]
            for r in batch.to_pylist():
                c = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
                a, b, yy, n = c[:p, :p], c[:p, p], c[p, p], c[0, 0]
                try:
                    inverse = np.linalg.inv(a)
                except np.linalg.LinAlgError:
                    continue
                beta = inverse @ b
                rss, tss = yy - beta @ b, yy - b[0] ** 2 / n
                var = rss / (n - p)
                if not (var > 0 and tss > rss):
                    continue
                t = beta / np.sqrt(np.maximum(np.diag(inverse) * var, 1e-300))
                for o, v in zip(out, (r["code"], r["date"], int(n), t[1:].tolist(), float((tss - rss) / (p - 1) / var)), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.date32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.float64())), pa.array(out[4], pa.float64())], ["code", "date", "n", "t", "f"])

    return moments.mapInArrow(solve, "code string, date date, n long, t array<double>, f double")


C.add("MIN_13_lagged_regression", lambda s, d: lagged_regression(X.minutes(s, d)).select("code", "date", "n", *[F.col("t")[k].alias(f"t{k + 1}") for k in range(5)], "f"), values=("t1", "t2", "t3", "t4", "t5", "f"), digits=3)

# SQL for queries that had none
C.oracle["TS_24_ordered_map"] = "WITH RECURSIVE" + X.sql("""o AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars), r AS (SELECT code, date, close AS x, i FROM o WHERE i = 1
UNION ALL SELECT o.code, o.date, CASE WHEN o.close > 2 * r.x THEN o.close ELSE 0.9 * r.x + 0.1 * o.close END, o.i FROM r JOIN o ON o.code = r.code AND o.i = r.i + 1)
SELECT code, CAST(date AS VARCHAR) AS date, round(round(x, 6) + 1.7e-06, 4) AS value FROM r""").removeprefix("WITH")
C.oracle["XS_10_residual_styles"] = C.text("""r AS (SELECT code, date, close AS y, (rank() OVER (PARTITION BY date ORDER BY amount) + (count(*) OVER (PARTITION BY date, amount) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS a, (rank() OVER (PARTITION BY date ORDER BY vol) + (count(*) OVER (PARTITION BY date, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS b FROM bars),
m AS (SELECT *, count(*) OVER v AS n, avg(y) OVER v AS my, avg(a) OVER v AS ma, avg(b) OVER v AS mb, var_pop(a) OVER v AS aa, var_pop(b) OVER v AS bb, covar_pop(a, b) OVER v AS ab, covar_pop(a, y) OVER v AS ay, covar_pop(b, y) OVER v AS byy FROM r WINDOW v AS (PARTITION BY date))
SELECT code, date, CASE WHEN n >= 20 THEN y - my - (bb * ay - ab * byy) / (aa * bb - ab * ab) * (a - ma) - (aa * byy - ab * ay) / (aa * bb - ab * ab) * (b - mb) END AS value FROM m""", ("date",), ("value",), 4)
C.oracle["ES_02_deviation"] = X.sql("""r AS (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars), x AS (SELECT *, ret - quantile_cont(ret, 0.5) OVER (PARTITION BY date) AS x FROM r),
h AS (SELECT code, i, CASE WHEN count(x) OVER w = 3 THEN abs(sum(x) OVER w) > 5 END AS hit FROM x WINDOW w AS (PARTITION BY code ORDER BY date ROWS 2 PRECEDING)),
l AS (SELECT code, list([i] ORDER BY i) AS l FROM h WHERE hit GROUP BY 1)
SELECT code, CAST(len(list_reduce(l, lambda a, e: CASE WHEN e[1] - a[-1] > 3 THEN list_concat(a, e) ELSE a END)) AS BIGINT) AS n FROM l""")
C.oracle["MIN_10_follow"] = X.sql("""b AS (SELECT code, date, vol, row_number() OVER (PARTITION BY code, date ORDER BY datetime) - 1 AS i FROM minutes WHERE vol > 0),
p AS (SELECT code, date, list([i] ORDER BY vol DESC, i) AS c, list(vol ORDER BY i) AS v FROM b GROUP BY 1, 2),
t AS (SELECT code, date, v, list_reduce(c, lambda a, e: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda x: abs(x - e[1]) < 5)) = 0 THEN list_concat(a, e) ELSE a END) AS a FROM p)
SELECT code, CAST(date AS VARCHAR) AS date, CAST(len(a) AS BIGINT) AS n, round(round(list_avg(list_transform(a, lambda x: coalesce(list_sum(v[x + 2 : x + 6]), 0) / v[x + 1])), 6) + 1.7e-06, 4) AS value FROM t""")
C.add("A191_several", lambda s, d: formulas.batch(B(s, d), list(SQLS)), GRID + "".join(f", {n}v AS (WITH {q} SELECT '{n}' AS factor, date, code, value FROM x WHERE value IS NOT NULL)" for n, q in SQLS.items()) + " " + " UNION ALL ".join(f"SELECT * FROM {n}v" for n in SQLS), digits=3)

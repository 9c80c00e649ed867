"""Formula replicas, walk-forward composites, models by domain and for the head, weekday rebalancing, stateful streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.books import ON_TIME
from panelwright.catalog.formula_sql import TS
from panelwright.catalog.formulas import GRID, SQLS, W, _corr, _rank
from panelwright.catalog.judging import SQL as JUDGING
from panelwright.catalog.judging import features
from panelwright.catalog.minute_factors import FEATURES
from panelwright.catalog.named import factor
from panelwright.functions.elementwise import clip
from panelwright.operators import asof, panel, xs
from panelwright.streaming import bars as stream

C = X.Catalog()
B = X.bars


def _ts_rank(x: str, d: int) -> str:
    return TS["tsrank"](x, d)


def _decay(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - i} * " + (f"lag({x}, {i}) OVER w" if i else x) for i in range(n)) + f") / {n * (n + 1) / 2}"


_REPLICAS = {
    "pa_a101_040": f"a AS (SELECT code, date, high, v, CASE WHEN count(high) OVER (w ROWS 9 PRECEDING) >= 10 THEN stddev_samp(high) OVER (w ROWS 9 PRECEDING) END AS s, {_corr('high', 'v', 10)} AS k FROM g {W}), x AS (SELECT code, date, -({_rank('s')}) * k AS value FROM a)",
    "pa_a101_044": f"a AS (SELECT code, date, high, {_rank('v')} AS r FROM g), x AS (SELECT code, date, -({_corr('high', 'r', 5)}) AS value FROM a {W})",
    "pa_a101_088": f"""a AS (SELECT code, date, close, v, ({_rank('open')} + {_rank('low')}) - ({_rank('high')} + {_rank('close')}) AS z FROM g), b AS (SELECT code, date, {_decay('z', 8)} AS z, {_ts_rank('close', 8)} AS p, CASE WHEN count(v) OVER (w ROWS 59 PRECEDING) >= 60 THEN avg(v) OVER (w ROWS 59 PRECEDING) END AS m FROM a {W}),
e AS (SELECT code, date, z, p, {_ts_rank('m', 21)} AS q FROM b {W}), f AS (SELECT code, date, z, {_corr('p', 'q', 8)} AS k FROM e {W}), i AS (SELECT code, date, z, {_decay('k', 7)} AS y FROM f {W}),
u AS (SELECT code, date, z, {_ts_rank('y', 3)} AS t2 FROM i {W}), y AS (SELECT code, date, {_rank('z')} AS t1, t2 FROM u), x AS (SELECT code, date, CASE WHEN t2 IS NULL OR t1 <= t2 THEN t1 ELSE t2 END AS value FROM y)""",
    "pa_5d_min_low_ratio": f"x AS (SELECT code, date, CASE WHEN count(low) OVER (w ROWS 4 PRECEDING) >= 5 THEN min(low) OVER (w ROWS 4 PRECEDING) END / close AS value FROM g {W})",
}
for _name, _body in _REPLICAS.items():
    C.add(f"FA_41_{_name}", factor(f"41_{_name}"), GRID + ", " + _body + " SELECT date, code, value FROM x WHERE value IS NOT NULL", digits=3)

# Walk-forward composites of formulas and of minute features
WALK = """, jf AS (SELECT ff.*, fwd FROM ff JOIN (SELECT date, code, lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS fwd FROM {prices}) USING (date, code) WHERE value IS NOT NULL AND fwd IS NOT NULL),
rf AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY value) AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd) AS b FROM jf),
wi AS (SELECT factor, date, corr(a, b) AS rank_ic FROM rf GROUP BY 1, 2 HAVING count(*) >= {section}),
wj AS (SELECT factor, date, count(rank_ic) OVER v AS n, avg(rank_ic) OVER v AS m, stddev_samp(rank_ic) OVER v AS sd FROM wi WINDOW v AS (PARTITION BY factor ORDER BY date ROWS BETWEEN {far} PRECEDING AND {h} PRECEDING)),
wt AS (SELECT factor, date, sign(m) AS direction, abs(m / sd) AS weight FROM wj WHERE n >= {least} AND sd > 0),
zz AS (SELECT date, code, factor, CASE WHEN min(value) OVER v < max(value) OVER v THEN (value - avg(value) OVER v) / stddev_samp(value) OVER v END AS z FROM ff WHERE value IS NOT NULL WINDOW v AS (PARTITION BY factor, date))
SELECT date, code, sum(z * direction * weight) / sum(weight) AS score FROM zz JOIN wt USING (factor, date) WHERE z IS NOT NULL GROUP BY 1, 2"""
_FORMULAS = ("a109", "a134", "a162", "a167")


_FF = "".join(f", {n}v AS (WITH {SQLS[n]} SELECT '{n}' AS factor, date, code, round(value, 6) AS value FROM x WHERE value IS NOT NULL)" for n in _FORMULAS) + ", ff AS (" + " UNION ALL ".join(f"SELECT * FROM {n}v" for n in _FORMULAS) + ")"
C.add("FA_42_formula_composite", lambda s, d: factor("42_formula_composite")(s, d).withColumnRenamed("value", "score"), GRID + _FF + WALK.format(h=4, prices="bars", section=30, far=55, least=20), values=("score",), digits=2)
_MINUTE = {"rv": ("ln(1e4 * rv)", lambda: F.ln(1e4 * F.col("rv"))), "hhi": ("v_hhi", lambda: F.col("v_hhi")), "hi_pos": ("hi_pos", lambda: F.col("hi_pos"))}


C.add("FA_42_minute_composite", lambda s, d: factor("42_minute_composite")(s, d).withColumnRenamed("value", "score"), FEATURES + ", ff AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, date, code, round({x}, 6) AS value FROM f" for n, (x, _) in _MINUTE.items()) + ")" + WALK.format(h=1, prices="f", section=5, far=15, least=8), values=("score",), digits=2)


# Models by domain, and for the head
def _ranked(s, d):
    x = features(s, d, ("mom_4", "size"))
    return x.join(B(s, d).select("date", "code", clip(panel.forward_return("close", 4), -0.5, 0.5).alias("label")), ["date", "code"])


def _by_domain(s, d):
    """A linear model for each half of the section by size, learned before 1999, used after."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    m = VectorAssembler(inputCols=["mom_4", "size"], outputCol="features").transform(_ranked(s, d).withColumn("domain", (F.col("size") > 0.5).cast("int")))
    m = m.select("date", "code", "domain", "features", "label").persist()
    try:
        out = None
        for domain in (0, 1):
            fit = LinearRegression(solver="normal").fit(m.where((F.col("domain") == domain) & (F.col("date") < "1999-01-01") & F.col("label").isNotNull()))
            one = fit.transform(m.where((F.col("domain") == domain) & (F.col("date") >= "1999-01-01"))).select("date", "code", "domain", F.col("prediction").alias("score"))
            out = one if out is None else out.unionByName(one)
        return out
    finally:
        m.unpersist()


C.add("ML_04_by_domain", _by_domain, JUDGING + """, rk AS (SELECT date, code, factor, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY factor, date) AS r FROM factors WHERE value IS NOT NULL AND factor <> 'vol_12'),
p AS (SELECT date, code, max(r) FILTER (WHERE factor = 'mom_4') AS x, max(r) FILTER (WHERE factor = 'size') AS z FROM rk GROUP BY 1, 2),
m AS (SELECT p.*, CAST(z > 0.5 AS INTEGER) AS domain, least(greatest(fwd_4, -0.5), 0.5) AS y FROM p JOIN fwd USING (date, code) WHERE x IS NOT NULL AND z IS NOT NULL),
c AS (SELECT domain, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM m WHERE date < DATE '1999-01-01' AND y IS NOT NULL GROUP BY 1),
b AS (SELECT domain, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz, mx, mz, my FROM c)
SELECT date, code, domain, my + bx * (x - mx) + bz * (z - mz) AS score FROM m JOIN b USING (domain) WHERE date >= DATE '1999-01-01'""", values=("score",))


def _head(s, d):
    """The chance of standing in the top fifth of the next returns, by boosted trees learned before 1999."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    r = _ranked(s, d).withColumn("top", F.when(F.col("label").isNotNull(), (F.percent_rank().over(Window.partitionBy("date", F.col("label").isNotNull()).orderBy("label")) >= 0.8).cast("double")))
    m = VectorAssembler(inputCols=["mom_4", "size"], outputCol="features").transform(r).select("date", "code", "features", F.col("top").alias("label"))
    fit = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(m.where("date < '1999-01-01' and label is not null"))
    return fit.transform(m.where("date >= '1999-01-01'")).select("date", "code", F.round(vector_to_array("probability")[1], 3).alias("score"))


C.add("ML_04_head", _head, values=())


# Rebalancing on a day of the week
def weekday_dates(dates, days=(1, 2, 3, 4, 5)):
    """weekday, date, next: for each ISO weekday the rebalancing dates, one a week: that weekday where the calendar has it, else the week's first date."""
    week = F.trunc("date", "week")
    d = dates.select("date").distinct().withColumn("weekday", F.explode(F.array(*[F.lit(x) for x in days])))
    iso = F.weekday("date") + 1
    d = d.groupBy("weekday", week.alias("week")).agg(F.coalesce(F.min(F.when(iso == F.col("weekday"), F.col("date"))), F.min("date")).alias("date"))
    return d.select("weekday", "date", F.lead("date").over(Window.partitionBy("weekday").orderBy("week")).alias("next"))


def _daily(s, d):
    p = F.round(F.col("l_extendedprice") * 100).cast("long")
    return X.table(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("date")).agg((F.sum(p).cast("double") / F.sum("l_quantity") / 100).alias("close"), (F.sum(p).cast("double") / 100).alias("amount"))


def _weekday(s, d):
    """Mean return from one rebalancing to the next of the ten greatest amounts of the day, for each weekday."""
    b = _daily(s, d)
    top = panel.top_per_date(b, "amount", 10).select("date", "code", F.col("close").alias("c0"))
    h = top.join(weekday_dates(b), "date").where("next is not null")
    h = asof.asof(h, b.select("code", "date", "close"), ["close"], left_on="next")
    return h.groupBy("weekday", "date").agg(F.avg(F.col("close") / F.col("c0") - 1).alias("r")).groupBy("weekday").agg(F.count("*").alias("n"), F.avg("r").alias("value"))


C.add("PF_21_weekday", _weekday, """SELECT weekday, count(*) AS n, avg(r) AS value FROM (
  WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / sum(l_quantity) / 100 AS close, CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 AS amount FROM lineitem GROUP BY 1, 2),
  w AS (SELECT CAST(k AS INTEGER) AS weekday, date_trunc('week', date) AS week, coalesce(min(date) FILTER (WHERE isodow(date) = k), min(date)) AS date FROM (SELECT DISTINCT date FROM b) CROSS JOIN range(1, 6) t(k) GROUP BY 1, 2),
  n AS (SELECT weekday, date, lead(date) OVER (PARTITION BY weekday ORDER BY week) AS next FROM w),
  h AS (SELECT weekday, n.date, next, code, close AS c0 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS k FROM b) t JOIN n ON n.date = t.date WHERE k <= 10 AND next IS NOT NULL)
  SELECT weekday, h.date, avg(b.close / c0 - 1) AS r FROM h ASOF JOIN b ON b.code = h.code AND h.next >= b.date GROUP BY 1, 2) GROUP BY 1""", dates=())
#: The events that are no later than the watermark lets in; here the two kinds alone move it.
SEEN = ON_TIME.replace("FROM events)", "FROM events WHERE event_type IN ('view', 'purchase'))") + ", seen AS (SELECT * FROM timed WHERE mark IS NULL OR ts > mark) "
C.add("SS_04_last_value", stream.last_value, SEEN + "SELECT p.event_id, CAST(p.user_id AS VARCHAR) AS code, v.value FROM (SELECT * FROM seen WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM seen WHERE event_type = 'view') v ON v.user_id = p.user_id AND p.ts >= v.ts", dates=())

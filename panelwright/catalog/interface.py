"""The factor registry at work, and weight methods and caps, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.books import HELD, held
from panelwright.operators import panel, ts
from panelwright.plans import registry as rg
from panelwright.plans import weights as wt
from panelwright.sources.folders import fresh

C = X.Catalog()
R = rg.Registry()
R.add(rg.Factor("momentum_20", {"panel": ("close",)}, "price", "return over 20 rows", column=lambda: ts.change("close", 20)))
R.add(rg.Factor("reversal_5", {"panel": ("close",)}, "price", "return over 5 rows, turned round", column=lambda: -ts.change("close", 5)))
R.add(rg.Factor("volatility_20", {"panel": ("ret",)}, "price", "deviation of returns over 20 rows", column=lambda: ts.std("ret", 20, 2)))
R.add(rg.Factor("flat", {"panel": ("close",)}, "test", "a constant, which no check lets through", column=lambda: F.col("close") * 0))
R.add(rg.Factor("amplitude_20", {"panel": ("high", "low", "close")}, "price", "mean range over 20 rows, in SQL", sql="""SELECT code, date, avg((high - low) / close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS value FROM {panel} LEFT SEMI JOIN {universe} USING (code)"""))


@R.register("balance_share", {"panel": ("amount",), "groups": ("balance",)}, category="state", description="amount over the present balance")
def _balance(tables):
    return tables["panel"].join(tables["groups"].select("code", "balance"), "code").select("code", "date", (F.col("amount") / F.abs("balance")).alias("value"))


def tables(s, d):
    return {"panel": panel.returns(X.bars(s, d)), "groups": X.groups(s, d)}


FACTORS = """p AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
momentum_20 AS (SELECT 'momentum_20' AS factor, date, code, close / lag(close, 20) OVER w - 1 AS value FROM p WINDOW w AS (PARTITION BY code ORDER BY date)),
reversal_5 AS (SELECT 'reversal_5' AS factor, date, code, -(close / lag(close, 5) OVER w - 1) AS value FROM p WINDOW w AS (PARTITION BY code ORDER BY date)),
volatility_20 AS (SELECT 'volatility_20' AS factor, date, code, CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) >= 2 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) END AS value FROM p WINDOW w AS (PARTITION BY code ORDER BY date)),
amplitude_20 AS (SELECT 'amplitude_20' AS factor, date, code, avg((high - low) / close) OVER (w ROWS 19 PRECEDING) AS value FROM p WINDOW w AS (PARTITION BY code ORDER BY date)),
flat AS (SELECT 'flat' AS factor, date, code, close * 0 AS value FROM p),
balance_share AS (SELECT 'balance_share' AS factor, date, code, amount / abs(balance) AS value FROM p JOIN groups USING (code))
"""
NAMES = ["momentum_20", "reversal_5", "volatility_20", "amplitude_20", "flat", "balance_share"]
UNION = " UNION ALL ".join(f"SELECT * FROM {n}" for n in NAMES)

C.add("UX_01_registered", lambda s, d: R.compute(NAMES, tables(s, d)).join(R.described(s), "factor").select("factor", "category", "kind", "date", "code", "value"), FACTORS + f", k AS (SELECT * FROM (VALUES ('momentum_20', 'price', 'column'), ('reversal_5', 'price', 'column'), ('volatility_20', 'price', 'column'), ('amplitude_20', 'price', 'sql'), ('flat', 'test', 'column'), ('balance_share', 'state', 'build')) t(factor, category, kind)) SELECT factor, category, kind, date, code, value FROM ({UNION}) JOIN k USING (factor)")


def _within(s, d):
    """A SQL factor over the codes of one region, in a range of dates."""
    inside = X.groups(s, d).where("coarse = '1'").select("code")
    return R.compute(["amplitude_20"], tables(s, d), inside, "1997-01-01", "1999-12-31").select("date", "code", "value")


C.add("UX_02_sql_factor", _within, FACTORS + "SELECT date, code, value FROM amplitude_20 JOIN groups USING (code) WHERE coarse = '1' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")


def _saved(s, d):
    """Two ranges of dates saved one after the other; what is read back holds both, and no factor that fails the check."""
    folder, t = fresh(s, "factor-lake"), R.stored(NAMES, tables(s, d))
    rg.save(R.compute(NAMES, t, last="1998-12-31"), folder)
    rg.save(R.compute(NAMES, t, first="1998-06-01"), folder, "merge")
    return s.read.schema("date date, code string, value double, factor string").parquet(folder).groupBy("factor").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("value").alias("value"))


C.add("UX_05_saved", _saved, FACTORS + f"SELECT factor, count(*) AS n, min(date) AS first, max(date) AS last, avg(value) AS value FROM ({UNION}) WHERE value IS NOT NULL AND factor <> 'flat' GROUP BY 1", dates=("first", "last"))
C.add("UX_06_checked", lambda s, d: rg.sanity(R.compute(NAMES, tables(s, d))), FACTORS + f", c AS (SELECT factor, code, count(*) AS n, count(value) AS k, min(value) = max(value) AS still FROM ({UNION}) GROUP BY 1, 2), f AS (SELECT factor, sum(k) / sum(n) AS valid, avg(CAST(still AS DOUBLE)) AS constant FROM c GROUP BY 1) SELECT factor, valid, constant, valid >= 0.05 AND constant <= 0.5 AS ok FROM f", dates=(), values=("valid", "constant"))


def _caveats(s, d):
    """Rows of each factor, and whether it reads what is only known as of now."""
    flagged = R.caveats({"groups": ("balance", "fine", "coarse")})
    n = R.compute(NAMES, tables(s, d)).groupBy("factor").agg(F.count("value").alias("n"))
    return n.withColumn("caveat", F.when(F.col("factor").isin(list(flagged)), ", ".join(sorted(x for v in flagged.values() for x in v))))


C.add("PIT_14_state_columns", _caveats, FACTORS + f"SELECT factor, count(value) AS n, CASE WHEN factor = 'balance_share' THEN 'groups.balance' END AS caveat FROM ({UNION}) GROUP BY 1", dates=(), values=())


# A table of directions applied to factors, by a join with one row a factor.
DIRECTIONS = {"momentum_20": -1, "reversal_5": 1, "volatility_20": -1, "amplitude_20": -1}


def _directed(s, d):
    t = s.createDataFrame(list(DIRECTIONS.items()), "factor string, direction int")
    f = R.compute(list(DIRECTIONS), tables(s, d)).where("value is not null").join(F.broadcast(t), "factor")
    return f.groupBy("factor", "direction").agg(F.avg(F.col("value") * F.col("direction")).alias("value"))


C.add("CM_05_directions", _directed, FACTORS + f", t AS (SELECT * FROM (VALUES {', '.join(repr(x) for x in DIRECTIONS.items())}) v(factor, direction)) SELECT factor, CAST(direction AS INTEGER) AS direction, avg(value * direction) AS value FROM ({UNION}) JOIN t USING (factor) WHERE value IS NOT NULL GROUP BY 1, 2", dates=())

# Weights
_R20 = "sd AS (SELECT date, code, CASE WHEN count(ret) OVER v >= 20 THEN stddev_pop(ret) OVER v END AS sd FROM o WINDOW v AS (PARTITION BY code ORDER BY date ROWS 29 PRECEDING))"


def _methods(s, d):
    r = panel.returns(X.bars(s, d)).select("date", "code", "ret")
    out = None
    for m in ("equal", "inverse_vol"):
        w = wt.weights(m, held(s, d), r).select(F.lit(m).alias("method"), "date", "code", F.col("weight").alias("value"))
        out = w if out is None else out.unionByName(w)
    return out


C.add("UX_04_weight_methods", _methods, HELD + f", {_R20}, i AS (SELECT date, code, 1 / sd AS w FROM held JOIN sd USING (date, code) WHERE sd > 0) SELECT 'equal' AS method, date, code, 1.0 / count(*) OVER (PARTITION BY date) AS value FROM held UNION ALL SELECT 'inverse_vol', date, code, w / sum(w) OVER (PARTITION BY date) FROM i")
for _m in ("min_var", "risk_parity"):
    C.add(f"PF_12_{_m}_weights", lambda s, d, m=_m: wt.weights(m, held(s, d), panel.returns(X.bars(s, d)).select("date", "code", "ret")).select("date", "code", F.col("weight").alias("value")))


def _amount_weights(s, d):
    h = held(s, d).join(X.bars(s, d).select("date", "code", "amount"), ["date", "code"])
    return h.withColumn("weight", F.col("amount") / F.sum("amount").over(wt.by_date()))


def _rounds(first: str, step: str, n: int) -> str:
    """The CTEs w0 to wn, each made of the one before."""
    return f", w0 AS ({first})" + "".join(f",\nw{i} AS ({step.format(w=f'w{i - 1}')})" for i in range(1, n + 1))


_OWN = "SELECT date, code, amount / sum(amount) OVER (PARTITION BY date) AS weight FROM held JOIN bars USING (date, code)"
_CUT = """SELECT date, code, CASE WHEN weight >= 0.15 - 1e-12 THEN 0.15 WHEN sum(weight) FILTER (WHERE weight < 0.15 - 1e-12) OVER v > 0 THEN weight * (1 + coalesce(sum(weight - 0.15) FILTER (WHERE weight >= 0.15 - 1e-12) OVER v, 0) / sum(weight) FILTER (WHERE weight < 0.15 - 1e-12) OVER v) ELSE weight END AS weight
  FROM {w} WINDOW v AS (PARTITION BY date)"""
C.add("PF_14_capped_weights", lambda s, d: wt.capped(_amount_weights(s, d), 0.15, 6).select("date", "code", F.col("weight").alias("value")), HELD + _rounds(_OWN, _CUT, 6) + " SELECT date, code, weight AS value FROM w6")
_GROUP = """SELECT date, code, coarse, x / sum(x) OVER (PARTITION BY date) AS weight FROM (SELECT date, code, coarse, weight * least(1, 0.3 * sum(weight) OVER (PARTITION BY date) / sum(weight) OVER (PARTITION BY date, coarse)) AS x FROM {w})"""
C.add("PF_15_group_capped_weights", lambda s, d: wt.group_capped(wt.equal(held(s, d), None).join(X.groups(s, d).select("code", "coarse"), "code"), "coarse", 0.3, 5).select("date", "code", F.col("weight").alias("value")), HELD + _rounds("SELECT date, code, coarse, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM held JOIN groups USING (code)", _GROUP, 5) + " SELECT date, code, weight AS value FROM w5")

"""Formula factors: one batch, and some by themselves against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.catalog.formula_sql import settled, text
from panelwright.plans import formulas, registry

C = X.Catalog()
GRID = """grid AS (SELECT c.code, d.date, b.open, b.high, b.low, b.close, b.vol AS v, b.amount / b.vol AS vwap FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.code = c.code AND b.date = d.date),
g AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret, open / NULL AS nothing FROM grid)
"""
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"


def _corr(x, y, d):
    f = f"OVER (w ROWS {d - 1} PRECEDING)"
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN "
    return f"CASE WHEN count({both}{x} END) {f} >= {d} AND min({both}{x} END) {f} < max({both}{x} END) {f} AND min({both}{y} END) {f} < max({both}{y} END) {f} THEN corr({x}, {y}) {f} END"


def _rank(x):
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {settled(x)} NULLS LAST) + (count(*) OVER (PARTITION BY date, {settled(x)}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


SQLS = {
    "a006": f"x AS (SELECT code, date, -({_corr('open', 'v', 10)}) AS value FROM g {W})",
    "a134": f"r AS (SELECT code, date, {_rank('close')} AS a, {_rank('v')} AS b FROM g), x AS (SELECT code, date, -({_corr('a', 'b', 10)}) AS value FROM r {W})",
    "a119": f"r AS (SELECT code, date, {_rank('vwap')} AS a, {_rank('v')} AS b FROM g), k AS (SELECT code, date, round({_corr('a', 'b', 5)}, 9) AS k FROM r {W}), x AS (SELECT code, date, -({_rank('k')}) AS value FROM k)",
    "a101": "x AS (SELECT code, date, (close - open) / (high - low + 1e-12) AS value FROM g)",
    "a162": f"x AS (SELECT code, date, -(close - lag(close) OVER w) AS value FROM g {W})",
    "a167": f"k AS (SELECT code, date, close / CASE WHEN count(low) OVER (w ROWS 4 PRECEDING) = 5 THEN min(low) OVER (w ROWS 4 PRECEDING) END - 1 AS k FROM g {W}), x AS (SELECT code, date, -({_rank('k')}) AS value FROM k)",
    "a109": f"x AS (SELECT code, date, -(CASE WHEN count(high) OVER (w ROWS 9 PRECEDING) = 10 THEN stddev_samp(high) OVER (w ROWS 9 PRECEDING) END / close) AS value FROM g {W})",
}
for _name, _body in SQLS.items():
    C.add(f"A191_{_name}", lambda s, d, n=_name: formulas.batch(X.bars(s, d), [n]).select("date", "code", "value"), GRID + ", " + _body + " SELECT date, code, value FROM x WHERE value IS NOT NULL", digits=3)
LIBRARY = formulas.library()


def _parts() -> list[dict]:
    order = sorted(LIBRARY, key=lambda k: (LIBRARY[k].phase, k))
    return [{k: LIBRARY[k] for k in order[i : i + formulas.TOGETHER]} for i in range(0, len(order), formulas.TOGETHER)]


#: All formulas in long form: (factor, date, code, value).
LONG = GRID + "".join(f",\n{text(part, f'p{i}')}" for i, part in enumerate(_parts())) + ",\nlong AS (" + " UNION ALL ".join(f"SELECT factor, date, code, value FROM (UNPIVOT p{i}values ON {', '.join(part)} INTO NAME factor VALUE value)" for i, part in enumerate(_parts())) + ")"


def _batch(s, d):
    """All formulas, by factor and code: rows with a value, dates, and the mean of the values drawn into -1 to 1, as some are very large."""
    day = lambda x: F.when(x.isNotNull(), F.col("date"))
    return formulas.by_code(X.bars(s, d), {"n": F.count, "first": lambda x: F.min(day(x)), "last": lambda x: F.max(day(x)), "value": lambda x: F.avg(x / (1 + F.abs(x)))}).where("n > 0")


C.add("A191_batch", _batch, LONG + " SELECT factor, code, count(*) AS n, min(date) AS first, max(date) AS last, avg(value / (1 + abs(value))) AS value FROM long WHERE value IS NOT NULL GROUP BY 1, 2", dates=("first", "last"))


def _status(s, d):
    """Per formula the share of the grid's cells with a value, the share of codes whose values stand still, and whether it may be saved."""
    b = X.bars(s, d)
    wide = formulas.evaluate(formulas.prepared(b), {k: f for k, f in formulas.library().items() if k in STATUS})
    long = wide.select("date", "code", F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("value")) for k in STATUS])).alias("x")).select("date", "code", "x.factor", "x.value")
    return registry.sanity(long)


#: Formulas that have SQL here.
STATUS = sorted(SQLS)
C.add("A191_status", _status, GRID + "".join(f", {n}v AS (WITH {q} SELECT '{n}' AS factor, code, value FROM x)" for n, q in SQLS.items()) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM {n}v" for n in SQLS) + "), k AS (SELECT factor, code, count(*) AS n, count(value) AS k, min(value) = max(value) AS still FROM u GROUP BY 1, 2) SELECT factor, sum(k) / sum(n) AS valid, avg(CAST(still AS DOUBLE)) AS constant, sum(k) / sum(n) >= 0.05 AND coalesce(avg(CAST(still AS DOUBLE)), 1) <= 0.5 AS ok FROM k GROUP BY 1", dates=(), values=("valid", "constant"))

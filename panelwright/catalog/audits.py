"""The library of factors as a whole: all in one job, ranges, and audits for knowledge of the future."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelwright.catalog import families, last, minute_factors, report_factors
from panelwright.catalog import fixtures as X
from panelwright.catalog.named import FACTORS, Inputs
from panelwright.operators import panel, ts
from panelwright.plans import replay as rp
from panelwright.plans import verdict as vd
from panelwright.plans.library import LIBRARY
from panelwright.plans.registry import Factor, Reach, Registry
from panelwright.sources.folders import fresh

C = X.Catalog()
SQL = {name: text for part in (families, last, minute_factors, report_factors) for name, text in part.C.oracle.items()}


def body(factor: str) -> str:
    """SQL of a factor's values as they are, without the rounding that the catalog shows them with."""
    query = next(q for q, f in FACTORS.items() if f == factor)
    return SQL[f"FA_{query}"].split("FROM (\n", 1)[1].rsplit("\n)", 1)[0]


# Everything at once
EVERYTHING = [f for q, f in FACTORS.items() if f"FA_{q}" in SQL]


def _everything(s, d):
    """All factors but formulas and composites in one job, summed up by factor and code."""
    with LIBRARY.kept(EVERYTHING, Inputs(s, d)) as t:
        return LIBRARY.each(EVERYTHING, t, lambda f: f.groupBy("factor", "code").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.avg(F.round("value", 6)).alias("value")))


C.add("UX_05_all_factors", _everything, "a AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, code, value FROM ({body(f)})" for f in EVERYTHING) + ") SELECT factor, code, count(*) AS n, count(value) AS filled, avg(round(value, 6)) AS value FROM a GROUP BY 1, 2", dates=(), digits=2)

_LISTED = {n: (LIBRARY.get(n).category, ",".join(sorted(LIBRARY.sources(n)))) for n in EVERYTHING if LIBRARY.sources(n) <= {"bars", "flow", "flows", "capital"} and LIBRARY.reach(n).rows is not None and LIBRARY.reach(n).rows < 30}


def _listed(s, d):
    """The factors of at most 30 rows that need bars, flows and shares alone: what is declared of them, and their values on the last date."""
    t = Inputs(s, d)
    last = t["bars"].agg(F.max("date").cast("string")).first()[0]
    f = LIBRARY.compute(list(_LISTED), t, first=last, last=last)
    about = LIBRARY.described(s).select("factor", "category", F.concat_ws(",", "reads").alias("reads"))
    return f.join(F.broadcast(about), "factor").select("factor", "category", "reads", "code", "value")


C.add("UX_01_library", _listed, "a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS factor, '{c}' AS category, '{r}' AS reads, code, date, value FROM ({body(n)})" for n, (c, r) in _LISTED.items()) + "), z AS (SELECT max(date) AS date FROM bars) SELECT factor, category, reads, code, value FROM a JOIN z USING (date)", dates=(), digits=3)

RANGE = ("1997-03-03", "1997-06-30")
_RANGED = ["momentum_60", "volatility_20", "rsi_14", "turn_idio_20", "qz_tsim_path_20", "boat_follow_20", "mf_smart_dumb_20", "team_coin_20", "inst_buy_20", "dividend_yield", "roe_ttm", "ep_report"]


def _ranged(s, d):
    """Some months from stored tables, of which only the rows that the factors reach back to are read."""
    folder, t = fresh(s, "panel"), Inputs(s, d)
    stored = dict(t)
    for name in ("bars", "flow", "flows", "seats", "actions"):
        t[name].write.parquet(f"{folder}/{name}")
        stored[name] = s.read.schema(t[name].schema).parquet(f"{folder}/{name}")
    return LIBRARY.compute(_RANGED, stored, first=RANGE[0], last=RANGE[1])


C.add("UX_05_range", _ranged, "a AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, date, code, value FROM ({body(f)})" for f in _RANGED) + f") SELECT factor, date, code, value FROM a WHERE date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'", digits=3)

# Replays. Three planted factors know the future: the next close, a mean around the date, a share of the highest close of all time.
AUDITED = Registry(LIBRARY.tables.values())
AUDITED.frames = LIBRARY.frames
AUDITED.factors = dict(LIBRARY.factors)
AUDITED.add(Factor("leak_next", {"priced": ("close",)}, "planted", column=lambda: panel.forward_return("close", 1), reach=Reach(1)))
AUDITED.add(Factor("leak_centred", {"priced": ("close",)}, "planted", column=lambda: F.avg("close").over(ts.rows(-3, 3)), reach=Reach(3)))
AUDITED.add(Factor("leak_high", {"priced": ("close",)}, "planted", column=lambda: F.col("close") / F.max("close").over(ts.rows(None, 10**6)), reach=Reach(None)))
AUDITED.add(Factor("flat", {"priced": ("close",)}, "planted", column=lambda: F.col("close") * 0 + 1, reach=Reach(0)))
AUDITED.add(Factor("sparse", {"priced": ("close",)}, "planted", column=lambda: F.when(F.month("date") == 1, F.col("close")), reach=Reach(0)))
PLANTED = {
    "leak_next": "SELECT code, date, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS value FROM bars",
    "leak_centred": "SELECT code, date, avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS value FROM bars",
    "leak_high": "SELECT code, date, close / max(close) OVER (PARTITION BY code) AS value FROM bars",
    "flat": "SELECT code, date, 1.0 AS value FROM bars",
    "sparse": "SELECT code, date, CASE WHEN month(date) = 1 THEN close END AS value FROM bars",
}
CUTS = [dt.date(1997, 3, 3), dt.date(1999, 6, 7)]
REPLAYED = ["momentum_20", "reversal_5", "volatility_60", "rsi_14", "price_position_250", "size", "amihud_20", "anchor_rev_vol_20", "overnight_mom_20", "team_coin_20", "boat_follow_20", "total_mcap", "turnover_std_20", "mf_main_pct_20", "turn_idio_20", "qz_tsim_path_20", "roe", "roe_ttm", "ep_report", "sue", "revenue_growth_yoy", "inst_buy_20", "retail_buy_20", "dividend_yield", "dragon_net_20", "block_premium_20", "leak_next", "leak_centred", "leak_high"]
SCRAMBLED = ["momentum_20", "volatility_20", "mf_main_pct_20", "turn_idio_20", "roe_ttm", "ep_report", "leak_next", "leak_centred", "leak_high"]
#: Whether a view's row was known on the evening of a date.
KNOWN = {"bars": "date <= {c}", "flow": "date <= {c}", "flows": "date <= {c}", "minutes": "date <= {c}", "seats": "date < {c}", "blocks": "date < {c}", "actions": "date <= {c} + 60", "capital": "date <= {c}", "items": "notice <= {c}", "reports": "notice <= {c}"}
NUMBERS = {"bars": ("open", "high", "low", "close", "vol", "amount"), "flow": ("main_net",), "flows": ("small_net", "net_amount"), "seats": ("net",), "blocks": ("amount", "price"), "actions": ("cash",), "capital": ("float_shares", "total_shares"), "reports": ("revenue", "net_profit"), "items": ("revenue", "net_profit", "operate_cf", "gross_profit", "op_profit", "total_assets", "total_liab", "total_equity", "inventory", "goodwill", "one_off", "current_ratio")}


def raw(factor: str) -> str:
    return X.sql(PLANTED[factor]) if factor in PLANTED else body(factor)


def as_of(factor: str, cut: dt.date, scramble: bool = False) -> str:
    """The factor's SQL over views without what was not known on that date, or with its numbers scrambled."""
    text = raw(factor)
    for view, known in KNOWN.items():
        known = known.format(c=f"DATE '{cut}'")
        where = f"SELECT * FROM ({X.VIEWS[view]}) WHERE {known}"
        if scramble and view in NUMBERS:
            where = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {known} THEN {n} ELSE {n} * {rp.SCRAMBLE[0]!r} + {rp.SCRAMBLE[1]!r} END AS {n}" for n in NUMBERS[view]) + f") FROM ({X.VIEWS[view]})"
        text = text.replace(f"{view} AS ({X.VIEWS[view]})", f"{view} AS ({where})")
    return text


def compared(names: list[str], scramble: bool = False, look: int | None = None, tag: str = "") -> str:
    """CTEs that end in replayed<tag>: what replay() gives."""
    whole, then = [], []
    for cut in CUTS:
        day = f"date = DATE '{cut}'" if not scramble else f"date <= DATE '{cut}'" + (f" AND date > DATE '{cut}' - {look}" if look else "")
        for f in names:
            for side, text in ((whole, raw(f)), (then, as_of(f, cut, scramble))):
                side.append(f"SELECT '{f}' AS factor, DATE '{cut}' AS cut, code, date, value FROM ({text}) WHERE {day}")
    return f"""whole{tag} AS ({" UNION ALL ".join(whole)}), known{tag} AS ({" UNION ALL ".join(then)}),
sides{tag} AS (SELECT factor, cut, w.value AS a, k.value AS b FROM whole{tag} w FULL JOIN known{tag} k USING (factor, cut, code, date)),
replayed{tag} AS (SELECT factor, cut, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(abs(a - b) <= 1e-9 * greatest(1, abs(a), abs(b)), a IS NULL AND b IS NULL)) AS different, max(abs(a - b)) AS worst FROM sides{tag} GROUP BY 1, 2)"""


def _replayed(s, d, names, **how):
    with AUDITED.kept(names, Inputs(s, d)) as t:
        return rp.replay(AUDITED, names, t, CUTS, **how)


C.add("PIT_06_truncation", lambda s, d: _replayed(s, d, REPLAYED), compared(REPLAYED) + " SELECT * FROM replayed", dates=("cut",), values=("worst",), digits=3)
C.add("PIT_07_mutation", lambda s, d: _replayed(s, d, SCRAMBLED, scramble=True, look=60), compared(SCRAMBLED, True, 60) + " SELECT * FROM replayed", dates=("cut",), values=("worst",), digits=3)

# Verdicts, and the composites that they let through
JUDGED = ["momentum_20", "price_position_250", "momentum_120", "skewness_20", "volatility_60", "leak_next", "flat", "sparse"]
COMPOSITES = [("steady", "momentum_20"), ("steady", "volatility_60"), ("hasty", "momentum_20"), ("hasty", "leak_next"), ("unknown", "volatility_60"), ("unknown", "no_such_factor")]


def _verdicts(s, d):
    with AUDITED.kept(JUDGED, Inputs(s, d)) as t:
        cut = rp.replay(AUDITED, JUDGED, t, CUTS).groupBy("factor").agg(F.sum("different").alias("different"))
        moved = rp.replay(AUDITED, JUDGED, t, CUTS, scramble=True, look=60).groupBy("factor").agg(F.sum("different").alias("moved"))
        about = AUDITED.each(JUDGED, t, vd.audit)
    return vd.verdicts(about.join(cut, "factor").join(moved, "factor"))


def _opened(s, d):
    return vd.gate(s.createDataFrame(COMPOSITES, "composite string, factor string"), _verdicts(s, d))


_RULES = ", ".join(f"({i}, '{r}', {vd.LEVELS.index(level) + 1}, '{m}', '{side}', {bound!r})" for i, (r, level, m, side, bound) in enumerate(vd.RULES))
_JUDGED = (
    compared(JUDGED, tag="_cut") + ", " + compared(JUDGED, True, 60, "_moved")
    + ", vals AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, code, date, value FROM ({raw(f)})" for f in JUDGED) + """),
by_date AS (SELECT factor, date, count(*) AS rows, count(value) AS n FROM vals GROUP BY 1, 2), m1 AS (SELECT factor, 1 - sum(n) / sum(rows) AS nulls, avg(CAST(n > 0 AS INTEGER)) AS covered FROM by_date GROUP BY 1),
m2 AS (SELECT factor, avg(CAST(a = b AS INTEGER)) AS constant FROM (SELECT factor, code, min(value) AS a, max(value) AS b FROM vals GROUP BY 1, 2) GROUP BY 1),
m3 AS (SELECT factor, sum(different) AS different FROM replayed_cut GROUP BY 1), m4 AS (SELECT factor, sum(different) AS moved FROM replayed_moved GROUP BY 1),
long AS (UNPIVOT (SELECT factor, CAST(nulls AS DOUBLE) AS nulls, CAST(covered AS DOUBLE) AS covered, CAST(constant AS DOUBLE) AS constant, CAST(different AS DOUBLE) AS different, CAST(moved AS DOUBLE) AS moved FROM m1 JOIN m2 USING (factor) JOIN m3 USING (factor) JOIN m4 USING (factor)) ON nulls, covered, constant, different, moved INTO NAME metric VALUE x),
rules AS (SELECT * FROM (VALUES """ + _RULES + """) t(i, rule, level, metric, side, bound)),
tripped AS (SELECT factor, i, rule, level, CASE side WHEN 'above' THEN x > bound ELSE x < bound END AS t FROM long JOIN rules USING (metric)),
judged AS (SELECT factor, ['PASS', 'WARN', 'FAIL'][max(CASE WHEN t THEN level ELSE 1 END)] AS verdict, coalesce(string_agg(rule, ',' ORDER BY i) FILTER (WHERE t), '') AS tripped FROM tripped GROUP BY 1)"""
)
C.add("PIT_10_rules", _verdicts, _JUDGED + " SELECT * FROM judged", dates=(), values=())
C.add("PIT_10_gate", _opened, _JUDGED + f", c AS (SELECT * FROM (VALUES {', '.join(map(repr, COMPOSITES))}) t(composite, factor)) SELECT composite, count(*) AS members, CAST(sum(CAST(coalesce(verdict = 'FAIL', true) AS INTEGER)) AS BIGINT) AS failed, sum(CAST(coalesce(verdict = 'FAIL', true) AS INTEGER)) = 0 AS open FROM c LEFT JOIN judged USING (factor) GROUP BY 1", dates=(), values=())

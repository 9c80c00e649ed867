"""Factor evaluation, metric tables, point-in-time audits, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.operators import asof, panel, ts, xs
from panelwright.plans import across
from panelwright.plans import evaluate as ev
from panelwright.sources.folders import fresh

C = X.Catalog()
B = X.bars
_DEF = {
    "mom_4": (lambda: ts.change("close", 4), "close / lag(close, 4) OVER v - 1"),
    "vol_12": (lambda: ts.std("ret", 12, 6), "CASE WHEN count(ret) OVER (v ROWS 11 PRECEDING) >= 6 THEN stddev_samp(ret) OVER (v ROWS 11 PRECEDING) END"),
    "size": (lambda: F.ln("amount"), "ln(amount)"),
}
SQL = """rets AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
factors AS (SELECT date, code, factor, CASE WHEN factor = 'vol_12' THEN round(raw, 9) ELSE raw END AS value FROM (
  """ + "\n  UNION ALL ".join(f"SELECT date, code, '{n}' AS factor, {q} AS raw FROM rets WINDOW v AS (PARTITION BY code ORDER BY date)" for n, (_, q) in _DEF.items()) + """)),
fwd AS (SELECT date, code, lead(close, 1) OVER v / close - 1 AS fwd_1, lead(close, 4) OVER v / close - 1 AS fwd_4, lead(close, 12) OVER v / close - 1 AS fwd_12 FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
joined AS (SELECT * FROM factors JOIN fwd USING (date, code)),
long AS (SELECT date, code, factor, value, 1 AS h, fwd_1 AS fwd FROM joined UNION ALL SELECT date, code, factor, value, 4, fwd_4 FROM joined UNION ALL SELECT date, code, factor, value, 12, fwd_12 FROM joined),
ranked AS (SELECT *, rank() OVER (PARTITION BY factor, date, h ORDER BY value) AS rv, rank() OVER (PARTITION BY factor, date, h ORDER BY fwd) AS rf FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT factor, date, h, count(*) AS n, corr(value, fwd) AS ic, corr(rv, rf) AS rank_ic FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 30)
"""


def _long(b, *kept: str):
    cols = {n: c() for n, (c, _) in _DEF.items()}
    long = b.withColumns(cols).select("date", "code", *kept, F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in cols])).alias("x")).select("date", "code", *kept, "x.factor", "x.value")
    return long.withColumn("value", F.when(F.col("factor") == "vol_12", F.round("value", 9)).otherwise(F.col("value")))


def wide(b, *kept: str):
    """The factors as columns: what _long() sets one under the other."""
    d = b.select("date", "code", *kept, *[c().alias(n) for n, (c, _) in _DEF.items()])
    return d.withColumn("vol_12", F.round("vol_12", 9))


def features(s, d, names=("mom_4", "size", "vol_12")):
    """date, code and the percentile ranks of the named factors, rows with all of them. Ranks are taken side by side in each date's section, so that no factor table is made long and wide again."""
    return ranked(wide(panel.returns(B(s, d))), names).na.drop()


def ranked(d, names, *kept: str):
    """date, code, the kept columns and the percentile ranks of the named ones, all from one sort by date."""
    return across.with_values(d, {f"_{n}": F.col(n) for n in names}, [(n, "rank_pct", f"_{n}") for n in names], ["date", "code", *kept])


def factors(s, d):
    return _long(panel.returns(B(s, d)))


def joined(s, d, h=(1, 4, 12)):
    """Factors with forward returns, which stand on the bars' rows before factors are set one under the other."""
    return _long(panel.forward_returns(panel.returns(B(s, d)), h), *[f"fwd_{x}" for x in h])


def ic(s, d):
    return ev.daily_ic(joined(s, d), (1, 4, 12))


def add(name, run, body, **k):
    C.add(name, run, SQL + body if body else None, **k)


def rank_ic(s, d, least: int = 30):
    """Daily rank IC of four-row momentum against the four-row forward return."""
    with X.nulls_for_errors(s):
        return ev.daily_ic(joined(s, d, (4,)).where("factor = 'mom_4'"), (4,), least).select("date", "n", F.col("rank_ic").alias("value"))


add("EV_01_rank_ic", rank_ic, "SELECT date, n, rank_ic AS value FROM ic WHERE factor = 'mom_4' AND h = 4")
add("EV_02_ic_horizons", lambda s, d: ic(s, d), "SELECT factor, date, CAST(h AS INTEGER) AS h, n, ic, rank_ic FROM ic", values=("ic", "rank_ic"))
add("EV_03_ic_summary", lambda s, d: ev.ic_summary(ic(s, d)), "SELECT factor, CAST(h AS INTEGER) AS h, count(rank_ic) AS days, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS sd, avg(rank_ic) / stddev_samp(rank_ic) AS icir, avg(CAST(rank_ic > 0 AS INTEGER)) AS win, avg(n) AS avg_n FROM ic GROUP BY 1, 2", dates=(), values=("mean", "sd", "icir", "win", "avg_n"))
add("EV_04_half_life", lambda s, d: ev.half_life(ev.ic_summary(ic(s, d))), """, s AS (SELECT factor, h, abs(avg(rank_ic)) AS a FROM ic GROUP BY 1, 2),
p AS (SELECT *, max(a) OVER (PARTITION BY factor) AS peak FROM s),
q AS (SELECT * FROM (SELECT *, min(CASE WHEN a = peak THEN h END) OVER (PARTITION BY factor) AS at_h FROM p) WHERE h >= at_h),
r AS (SELECT *, lag(a) OVER (PARTITION BY factor ORDER BY h) AS a0, lag(h) OVER (PARTITION BY factor ORDER BY h) AS h0 FROM q)
SELECT factor, max(peak) AS peak, min(CASE WHEN a <= peak / 2 AND a0 > peak / 2 THEN h0 + (a0 - peak / 2) / (a0 - a) * (h - h0) END) AS half_life FROM r GROUP BY factor""", dates=(), values=("peak", "half_life"))
add("EV_05_icir_weights", lambda s, d: ev.ic_summary(ic(s, d)).where("h = 4").select("factor", F.abs("icir").alias("value")), "SELECT factor, abs(avg(rank_ic) / stddev_samp(rank_ic)) AS value FROM ic WHERE h = 4 GROUP BY 1", dates=())
BUCKETS = """, g AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 4 = 0),
u AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n FROM joined JOIN g USING (date) WHERE value IS NOT NULL AND fwd_4 IS NOT NULL),
k AS (SELECT *, ntile({n}) OVER (PARTITION BY factor, date ORDER BY value, code) AS q FROM u WHERE n >= 30),
buckets AS (SELECT factor, date, q, avg(fwd_4) AS ret, count(*) AS n FROM k GROUP BY 1, 2, 3)
"""
add("EV_06_quantile_backtest", lambda s, d: ev.quantile_returns(joined(s, d, (4,)), 4, 5), BUCKETS.format(n=5) + "SELECT factor, date, CAST(q AS INTEGER) AS q, ret, n FROM buckets", values=("ret",))
add("EV_07_decile_monotone", lambda s, d: ev.monotonicity(ev.quantile_returns(joined(s, d, (4,)), 4, 10)), BUCKETS.format(n=10) + ", mm AS (SELECT factor, q, rank() OVER (PARTITION BY factor ORDER BY avg(ret)) AS r FROM buckets GROUP BY 1, 2) SELECT factor, corr(q, r) AS monotone FROM mm GROUP BY factor", dates=(), values=("monotone",))
add("EV_08_yearly_ic", lambda s, d: ic(s, d).where("h = 4").rollup("factor", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("rank_ic").alias("value"), F.count("rank_ic").alias("n")), "SELECT factor, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, avg(rank_ic) AS value, count(rank_ic) AS n FROM ic WHERE h = 4 GROUP BY ROLLUP (factor, year(date), month(date))", dates=())


def _residual_ic(s, d):
    b = panel.forward_returns(panel.returns(B(s, d)), (4,)).withColumns({"x": ts.change("close", 4), "s": F.ln("amount")})
    r = b.withColumn("value", F.round(xs.residual("x", "s"), 9)).withColumn("factor", F.lit("mom_4"))
    return ev.daily_ic(r, (4,)).select("date", "n", F.col("rank_ic").alias("value"))


add("EV_09_residual_ic", _residual_ic, """, x AS (SELECT date, code, close / lag(close, 4) OVER v - 1 AS x, ln(amount) AS s, lead(close, 4) OVER v / close - 1 AS fwd FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
y AS (SELECT *, CASE WHEN x IS NOT NULL THEN s END AS t FROM x),
r AS (SELECT date, fwd, round(x - avg(x) OVER w - covar_samp(x, t) OVER w / var_samp(t) OVER w * (t - avg(t) OVER w), 9) AS v FROM y WINDOW w AS (PARTITION BY date)),
k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY v) AS a, rank() OVER (PARTITION BY date ORDER BY fwd) AS b FROM r WHERE v IS NOT NULL AND fwd IS NOT NULL)
SELECT date, count(*) AS n, corr(a, b) AS value FROM k GROUP BY date HAVING count(*) >= 30""")


def _exposure(s, d):
    f = factors(s, d).where("factor in ('mom_4', 'size')")
    return ev.pairwise(f).select("a", "b", F.col("rho").alias("value"), "days")


PAIRS = """, j AS (SELECT x.date, x.factor AS a, y.factor AS b, x.value AS va, y.value AS vb FROM factors x JOIN factors y ON x.date = y.date AND x.code = y.code AND x.factor < y.factor WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
rr AS (SELECT *, rank() OVER (PARTITION BY a, b, date ORDER BY va) AS ra, rank() OVER (PARTITION BY a, b, date ORDER BY vb) AS rb FROM j),
cc AS (SELECT a, b, date, count(*) AS n, corr(ra, rb) AS rho FROM rr GROUP BY 1, 2, 3 HAVING count(*) >= 30)
"""
add("EV_10_style_exposure", _exposure, PAIRS + "SELECT a, b, avg(rho) AS value, count(rho) AS days FROM cc WHERE a = 'mom_4' AND b = 'size' GROUP BY 1, 2", dates=())


def _tilt(s, d):
    b = B(s, d).withColumns({"p": F.percent_rank().over(Window.partitionBy("date").orderBy("amount", "code")), "x": ts.change("close", 4)})
    b = b.withColumn("q", xs.ntile("x", 5)).where("q = 5")
    return b.groupBy(F.year("date").alias("year")).agg(F.median("p").alias("value"))


add("EV_11_size_tilt", _tilt, """, b AS (SELECT date, code, percent_rank() OVER (PARTITION BY date ORDER BY amount, code) AS p, close / lag(close, 4) OVER (PARTITION BY code ORDER BY date) - 1 AS x FROM bars),
q AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY x, code) AS q FROM b WHERE x IS NOT NULL)
SELECT CAST(year(date) AS INTEGER) AS year, median(p) AS value FROM q WHERE q = 5 GROUP BY 1""", dates=())
add("EV_12_similarity", lambda s, d: ev.pairwise(factors(s, d)), PAIRS + "SELECT a, b, avg(rho) AS rho, count(rho) AS days FROM cc GROUP BY 1, 2", dates=(), values=("rho",))


def _discoveries(s, d):
    t = ev.ic_summary(ic(s, d)).select(F.concat_ws("@", "factor", "h").alias("factor"), (F.col("icir") * F.sqrt("days")).alias("t"))
    return ev.discoveries(t)


add("EV_13_discoveries", _discoveries, """, t AS (SELECT factor || '@' || h AS factor, avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(rank_ic)) AS t FROM ic GROUP BY factor, h),
x AS (SELECT factor, t, abs(t) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) AS k FROM t),
p AS (SELECT factor, t, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-x * x) AS p FROM x),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, factor) AS raw FROM p)
SELECT factor, t, p, least(1.0, min(raw) OVER (ORDER BY p, factor ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, abs(t) > 3 AS strong FROM r""", dates=(), values=("t", "p", "q"))


def _leave_out(s, d):
    i = ic(s, d).where("h = 4").select("factor", F.year("date").alias("year"), "rank_ic")
    years = i.select("year").distinct().select(F.col("year").alias("dropped"))
    e = i.join(F.broadcast(years)).where("year <> dropped").groupBy("factor", "dropped").agg((F.avg("rank_ic") / F.stddev_samp("rank_ic")).alias("icir"))
    return e.groupBy("factor").agg(F.min("icir").alias("low"), F.max("icir").alias("high"))


add("EV_14_leave_one_year", _leave_out, """, i AS (SELECT factor, year(date) AS y, rank_ic FROM ic WHERE h = 4),
e AS (SELECT factor, d.y AS dropped, avg(rank_ic) / stddev_samp(rank_ic) AS icir FROM i JOIN (SELECT DISTINCT y FROM i) d ON i.y <> d.y GROUP BY 1, 2)
SELECT factor, min(icir) AS low, max(icir) AS high FROM e GROUP BY 1""", dates=(), values=("low", "high"))


def _regime(s, d):
    m = panel.returns(B(s, d)).groupBy("date").agg(F.median("ret").alias("m"))
    m = m.withColumn("up", F.avg("m").over(Window.orderBy("date").rowsBetween(-12, -1)) > 0)
    return ic(s, d).where("h = 4").join(m, "date").groupBy("factor", "up").agg(F.avg("rank_ic").alias("value"), F.count("*").alias("n"))


add("EV_15_regimes", _regime, """, m AS (SELECT date, median(ret) AS m FROM rets GROUP BY date),
u AS (SELECT date, avg(m) OVER (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) > 0 AS up FROM m)
SELECT factor, up, avg(rank_ic) AS value, count(*) AS n FROM ic JOIN u USING (date) WHERE h = 4 GROUP BY 1, 2""", dates=())


#: The modulus of shuffle keys: a Mersenne prime.
PRIME = (1 << 31) - 1


def _permuted(s, d, times: int = 500):
    """For each factor, the share of in-date shuffles whose mean rank IC is at least as far from 0 as the real one.

    A task holds one factor and date, and gives one correlation for each shuffle; shuffle 0 is the real order.
    Shuffle k orders codes by (a (2k + 1) + b k k) mod PRIME, where a and b are digits of the digest of factor,
    date and code: a uniform order for each k, independent for each two, that any engine repeats. One shuffle is
    made at a time: its keys come from those before by two sums, and key and place are sorted as one number.
    """

    def shuffled(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("code")
        there = np.ones(t.num_rows, bool)
        x, y = (across.rank(t[c].to_numpy(), there)[0] for c in ("value", "fwd_4"))
        ic = np.full(times + 1, np.nan)
        if len(x) >= 30 and np.ptp(x) > 0 and np.ptp(y) > 0:
            x, y = ((v - v.mean()) / np.linalg.norm(v - v.mean()) for v in (x, y))
            ic[0] = x @ y
            a, b = t["a"].to_numpy(), t["b"].to_numpy()
            key, step, more, place = a % PRIME, (2 * a + b) % PRIME, 2 * b % PRIME, np.arange(len(x))
            for k in range(1, times + 1):
                key = key + step
                key -= PRIME * (key >= PRIME)
                step += more
                step -= PRIME * (step >= PRIME)
                order = key << 32 | place
                order.sort()
                ic[k] = x @ y.take(order & 0xFFFFFFFF)
        n = np.arange(times + 1, dtype=np.int32)
        return pa.table({"factor": pa.array([t["factor"][0].as_py()] * len(n), pa.string()), "k": pa.array(n), "ic": pa.array(ic, mask=np.isnan(ic))})

    j = joined(s, d, (4,)).where("value is not null and fwd_4 is not null")
    by = ("factor", "date")
    digest = F.md5(F.concat_ws("|", "factor", F.col("date").cast("string"), "code").cast("binary"))
    digits = lambda i: F.conv(F.substring(digest, i, 7), 16, 10).cast("long")
    # shuffles take far longer than their rows are large, so sections are not put together by size
    j = across.dealt(j.select("factor", "date", "code", "value", "fwd_4"), *by).withColumns({"a": digits(1), "b": digits(8)})
    k = j.groupBy(*by).applyInArrow(shuffled, "factor string, k int, ic double").groupBy("factor", "k").agg(F.avg("ic").alias("ic"))
    # a window over the few means: a join of them with themselves would make all shuffles twice
    k = k.withColumn("value", F.max(F.when(F.col("k") == 0, F.col("ic"))).over(Window.partitionBy("factor")))
    hits = k.where("k > 0 and value is not null").groupBy("factor", "value").agg(F.count(F.when(F.abs("ic") >= F.abs("value"), 1)).alias("hits"))
    return hits.select("factor", "value", ((F.col("hits") + 1) / (times + 1)).alias("p"))


add("EV_16_permutation", _permuted, f""", j AS (SELECT factor, date, code, rv, rf, md5(factor || '|' || CAST(date AS VARCHAR) || '|' || code) AS m FROM ranked WHERE h = 4),
u AS (SELECT *, CAST('0x' || substr(m, 1, 7) AS BIGINT) AS a, CAST('0x' || substr(m, 8, 7) AS BIGINT) AS b FROM j),
t AS (SELECT factor, date, count(*) AS n, list(rv ORDER BY code) AS x, list(rf ORDER BY code) AS y, list(a ORDER BY code) AS a, list(b ORDER BY code) AS b, avg(rv) AS mx, avg(rf) AS my, stddev_pop(rv) AS sx, stddev_pop(rf) AS sy FROM u GROUP BY 1, 2 HAVING count(*) >= 30 AND min(rv) < max(rv) AND min(rf) < max(rf)),
p AS (SELECT *, k, CASE WHEN k = 0 THEN range(1, n + 1) ELSE list_grade_up(list_transform(range(1, n + 1), lambda i: (a[i] * (2 * k + 1) + b[i] * k * k) % {PRIME})) END AS o FROM t CROSS JOIN range(0, 501) r(k)),
s AS (SELECT factor, k, avg((list_sum(list_transform(range(1, n + 1), lambda i: x[i] * y[o[i]])) / n - mx * my) / (sx * sy)) AS ic FROM p GROUP BY 1, 2),
z AS (SELECT factor, ic AS value FROM s WHERE k = 0)
SELECT factor, value, (count(*) FILTER (WHERE abs(ic) >= abs(value)) + 1) / 501.0 AS p FROM s JOIN z USING (factor) WHERE k > 0 GROUP BY 1, 2""", dates=(), values=("value", "p"))


def _tail(s, d):
    j = joined(s, d, (4,)).where("factor = 'mom_4' and value is not null and fwd_4 is not null")
    j = j.join(F.broadcast(panel.every_kth(B(s, d), 4)), "date").withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code")))
    return j.groupBy("date").agg((F.avg(F.when(F.col("r") <= 10, F.col("fwd_4"))) - F.avg("fwd_4")).alias("value"))


add("EV_17_tail_selection", _tail, """, g AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 4 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS r FROM joined JOIN g USING (date) WHERE factor = 'mom_4' AND value IS NOT NULL AND fwd_4 IS NOT NULL)
SELECT date, avg(fwd_4) FILTER (WHERE r <= 10) - avg(fwd_4) AS value FROM r GROUP BY date""")
add("EV_18_coverage", lambda s, d: ev.coverage(factors(s, d), B(s, d)), """, n AS (SELECT factor, date, count(*) AS n FROM factors WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS k, lead(n) OVER (PARTITION BY factor ORDER BY date DESC) AS before FROM n),
c AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS behind FROM (SELECT DISTINCT date FROM bars))
SELECT factor, date, n, before, behind, behind <= 1 AND n >= 0.9 * coalesce(before, n) AS ok FROM k JOIN c USING (date) WHERE k = 1""", values=())
add("EV_19_newey_west", lambda s, d: ev.newey_west(ic(s, d).where("h = 4"), "rank_ic", 3, "factor"), """, e AS (SELECT factor, date, rank_ic AS x, rank_ic - avg(rank_ic) OVER (PARTITION BY factor) AS e FROM ic WHERE h = 4),
l AS (SELECT *, lag(e, 1) OVER v AS l1, lag(e, 2) OVER v AS l2, lag(e, 3) OVER v AS l3 FROM e WINDOW v AS (PARTITION BY factor ORDER BY date)),
s AS (SELECT factor, count(*) AS n, avg(x) AS mean, (sum(e * e) + 1.5 * sum(e * l1) + sum(e * l2) + 0.5 * sum(e * l3)) / count(*) AS v FROM l GROUP BY 1)
SELECT factor, n, mean, CASE WHEN v > 0 THEN mean / sqrt(v / n) END AS t FROM s""", dates=(), values=("mean", "t"))
add("EV_20_long_short", lambda s, d: ev.long_short(ev.quantile_returns(joined(s, d, (4,)), 4, 5), 5, 13.0), BUCKETS.format(n=5) + """, l AS (SELECT factor, date, max(ret) FILTER (WHERE q = 5) - max(ret) FILTER (WHERE q = 1) AS ls FROM buckets GROUP BY 1, 2),
c AS (SELECT *, sum(ls) OVER (PARTITION BY factor ORDER BY date) AS nav FROM l), dd AS (SELECT *, nav - max(nav) OVER (PARTITION BY factor ORDER BY date) AS dd FROM c)
SELECT factor, count(*) AS n, avg(ls) AS mean, avg(ls) / (stddev_samp(ls) / sqrt(count(*))) AS t, avg(ls) * 13 AS annual, avg(CAST(ls > 0 AS INTEGER)) AS win, min(dd) AS drawdown FROM dd GROUP BY 1""", dates=(), values=("mean", "t", "annual", "win", "drawdown"))

# Metric tables
H = (1, 2, 4, 8, 12)


def _metrics(s, d):
    b = panel.returns(B(s, d)).withColumns({n: c() for n, (c, _) in _DEF.items()}).withColumn("vol_12", F.round("vol_12", 9))
    return ev.daily_metrics(b.select("date", "code", "close", *_DEF), list(_DEF), H, (1, 5, 20))


def _metrics_sql() -> str:
    both = lambda h: f"CASE WHEN value IS NOT NULL AND fwd_{h} IS NOT NULL THEN "
    ranks = ", ".join(f"CASE WHEN value IS NOT NULL AND fwd_{h} IS NOT NULL THEN rank() OVER (PARTITION BY factor, date ORDER BY {both(h)}{x} END NULLS LAST) END AS {n}{h}" for h in H for x, n in (("value", "v"), (f"fwd_{h}", "f")))
    tiles = ", ".join(f"CASE WHEN value IS NOT NULL AND fwd_{h} IS NOT NULL THEN ntile(5) OVER (PARTITION BY factor, date, value IS NOT NULL AND fwd_{h} IS NOT NULL ORDER BY value, code) END AS q{h}" for h in (H[0], H[-1]))
    ics = ", ".join(f"CASE WHEN count(v{h}) >= 30 THEN corr(value, fwd_{h}) FILTER (WHERE v{h} IS NOT NULL) END AS ic_{h}, CASE WHEN count(v{h}) >= 30 THEN corr(v{h}, f{h}) END AS rank_ic_{h}" for h in H)
    rets = ", ".join(f"avg(fwd_{h}) FILTER (WHERE q{h} = {q}) AS ret_{h}_{q}" for h in (H[0], H[-1]) for q in range(1, 6))
    autos = ", ".join(f"corr(r, l{k}) AS auto_{k}" for k in (1, 5, 20))
    turns = ", ".join(f"CASE WHEN max(i) > 1 THEN 1 - count(*) FILTER (WHERE q = {q} AND was = {q}) / nullif(count(*) FILTER (WHERE q = {q}), 0) END AS turnover_{q}" for q in (1, 5))
    return f"""rets AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
fx AS (SELECT date, code, factor, CASE WHEN factor = 'vol_12' THEN round(raw, 9) ELSE raw END AS value FROM ({" UNION ALL ".join(f"SELECT date, code, '{n}' AS factor, {q} AS raw FROM rets WINDOW v AS (PARTITION BY code ORDER BY date)" for n, (_, q) in _DEF.items())})),
fw AS (SELECT date, code, {", ".join(f"lead(close, {h}) OVER v / close - 1 AS fwd_{h}" for h in H)} FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
dt AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)),
a AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY factor, date ORDER BY value NULLS LAST) END AS r, CASE WHEN value IS NOT NULL THEN ntile(5) OVER (PARTITION BY factor, date, value IS NOT NULL ORDER BY value, code) END AS q, {ranks}, {tiles} FROM fx JOIN fw USING (date, code) JOIN dt USING (date)),
l AS (SELECT *, {", ".join(f"CASE WHEN value IS NOT NULL THEN lag(r, {k}) OVER x END AS l{k}" for k in (1, 5, 20))}, CASE WHEN lag(i) OVER w = i - 1 THEN lag(q) OVER w END AS was FROM a WINDOW w AS (PARTITION BY factor, code ORDER BY date), x AS (PARTITION BY factor, code, value IS NOT NULL ORDER BY date))
SELECT factor, date, count(*) AS rows, count(value) AS n, count(value) / count(*) AS coverage, count(value) / count(*) < 0.5 AS degraded, stddev_samp(value) AS sd, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99, {ics}, {rets}, {autos}, {turns} FROM l GROUP BY 1, 2"""


_NUMBERS = ("coverage", "sd", "q01", "q50", "q99", *[f"{x}_{h}" for h in H for x in ("ic", "rank_ic")], *[f"ret_{h}_{q}" for h in (H[0], H[-1]) for q in range(1, 6)], "auto_1", "auto_5", "auto_20", "turnover_1", "turnover_5")
C.add("MS_01_daily_metrics", _metrics, _metrics_sql(), values=_NUMBERS)
add("MS_02_autocorrelation", lambda s, d: ev.autocorrelation(factors(s, d), 1), """, r AS (SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY value) AS r FROM factors WHERE value IS NOT NULL),
l AS (SELECT *, lag(r) OVER (PARTITION BY factor, code ORDER BY date) AS r0 FROM r)
SELECT factor, date, count(*) AS n, corr(r, r0) AS rho FROM l WHERE r0 IS NOT NULL GROUP BY 1, 2""", values=("rho",))
add("MS_03_bucket_turnover", lambda s, d: ev.bucket_turnover(factors(s, d), 5, 5), """, q AS (SELECT * FROM (SELECT *, ntile(5) OVER (PARTITION BY factor, date ORDER BY value, code) AS q FROM factors WHERE value IS NOT NULL) WHERE q = 5),
i AS (SELECT factor, date, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM (SELECT DISTINCT factor, date FROM factors)),
k AS (SELECT factor, date, i, code FROM q JOIN i USING (factor, date))
SELECT a.factor, a.date, 1 - count(b.code) / count(*) AS turnover FROM k a LEFT JOIN k b ON a.factor = b.factor AND a.code = b.code AND b.i = a.i - 1 WHERE a.i > 1 GROUP BY 1, 2""", values=("turnover",))
add("MS_05_core_correlation", lambda s, d: ev.pairwise(factors(s, d)).where("b = 'vol_12' or a = 'vol_12'"), PAIRS + "SELECT a, b, avg(rho) AS rho, count(rho) AS days FROM cc WHERE a = 'vol_12' OR b = 'vol_12' GROUP BY 1, 2", dates=(), values=("rho",))
add("MS_06_exposure_pivot", lambda s, d: ev.pairwise(factors(s, d)).groupBy("a").pivot("b", ["size", "vol_12"]).agg(F.max("rho")).select("a", F.col("size").alias("exp_size"), F.col("vol_12").alias("exp_vol_12")), PAIRS + "SELECT a, max(r) FILTER (WHERE b = 'size') AS exp_size, max(r) FILTER (WHERE b = 'vol_12') AS exp_vol_12 FROM (SELECT a, b, avg(rho) AS r FROM cc GROUP BY 1, 2) GROUP BY a", dates=(), values=("exp_size", "exp_vol_12"))
add("MS_07_rolling", lambda s, d: ev.rolling_metrics(ic(s, d), 20), """SELECT factor, CAST(h AS INTEGER) AS h, date, CASE WHEN count(rank_ic) OVER v >= 10 THEN avg(rank_ic) OVER v END AS mean, CASE WHEN count(rank_ic) OVER v >= 10 THEN avg(CAST(rank_ic > 0 AS INTEGER)) OVER v END AS win,
CASE WHEN count(rank_ic) OVER v >= 10 THEN avg(rank_ic) OVER v / (stddev_samp(rank_ic) OVER v / sqrt(count(rank_ic) OVER v)) END AS t FROM ic WINDOW v AS (PARTITION BY factor, h ORDER BY date ROWS 19 PRECEDING)""", values=("mean", "win", "t"))


def _last_matrix(s, d, days: int = 5):
    """Correlations over the last five dates whose sections are large enough."""
    f = factors(s, d)
    full = B(s, d).groupBy("date").agg(F.count("*").alias("n")).where("n >= 30").orderBy(F.desc("date")).limit(days)
    return ev.pairwise(f.join(F.broadcast(full.select("date")), "date", "left_semi"))


add("MS_08_matrix", _last_matrix, PAIRS + "SELECT a, b, avg(rho) AS rho, count(rho) AS days FROM cc WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(*) >= 30 ORDER BY date DESC LIMIT 5) GROUP BY 1, 2", dates=(), values=("rho",))
add("MS_09_sampled", lambda s, d: ev.pairwise(factors(s, d).join(F.broadcast(panel.every_kth(B(s, d), 10)), "date", "left_semi")), """, g AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 10 = 0)""" + PAIRS + "SELECT a, b, avg(rho) AS rho, count(rho) AS days FROM cc SEMI JOIN g USING (date) GROUP BY 1, 2", dates=(), values=("rho",))


def _crowd(s, d):
    """Mean pair correlation within each region, over all dates."""
    return ev.pair_corr_mean(panel.returns(B(s, d)).join(X.groups(s, d).select("code", "coarse"), "code"), "ret", "coarse")


add("MS_11_pair_correlation", _crowd, """, rg AS (SELECT coarse, code, date, ret FROM rets JOIN groups USING (code) WHERE ret IS NOT NULL), n AS (SELECT coarse, code, count(*) AS n FROM rg GROUP BY 1, 2),
u AS (SELECT coarse, code FROM n QUALIFY n = max(n) OVER (PARTITION BY coarse)), x AS (SELECT rg.* FROM rg JOIN u USING (coarse, code)), z AS (SELECT *, (ret - avg(ret) OVER v) / stddev_pop(ret) OVER v AS z FROM x WINDOW v AS (PARTITION BY coarse, code)),
p AS (SELECT coarse, date, sum(z) * sum(z) - sum(z * z) AS p, count(*) AS k FROM z GROUP BY 1, 2) SELECT coarse, max(k) AS codes, CASE WHEN max(k) > 1 THEN sum(p) / (count(*) * max(k) * (max(k) - 1)) END AS rho FROM p GROUP BY 1""", dates=(), values=("rho",))


def _crowding(s, d):
    """Sides of two factors on every fifth date: the fifth with the highest and the lowest values; 12 rows of returns stand for 60 days."""
    f = factors(s, d).where("factor <> 'size' and value is not null").join(F.broadcast(panel.every_kth(B(s, d), 5)), "date", "left_semi")
    q = f.withColumn("q", xs.ntile("value", 5, ("factor", "date"))).where("q in (1, 5)")
    b = B(s, d).select("date", "code", (F.col("amount") / F.col("vol") / F.col("close")).alias("bp"), F.col("vol").alias("turnover"))
    m = q.join(b, ["date", "code"]).select("factor", "date", "code", F.when(F.col("q") == 5, 1).otherwise(-1).alias("side"), F.col("value").alias("score"), "bp", "turnover")
    return ev.crowding(m, panel.returns(B(s, d)).where("ret is not null"), 12, 10, 20)


add("MS_11_crowding", _crowding, """, g AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 5 = 0),
q AS (SELECT factor, date, code, value, ntile(5) OVER (PARTITION BY factor, date ORDER BY value, code) AS q FROM factors SEMI JOIN g USING (date) WHERE factor <> 'size' AND value IS NOT NULL),
m AS (SELECT q.*, amount / vol / close AS bp, vol AS turnover FROM q JOIN bars USING (date, code) WHERE q IN (1, 5)),
s AS (SELECT factor, date, ln(quantile_cont(bp, 0.5) FILTER (WHERE q = 5) / quantile_cont(bp, 0.5) FILTER (WHERE q = 1)) AS spread, quantile_cont(turnover, 0.5) FILTER (WHERE q = 5) AS turnover FROM m GROUP BY 1, 2),
l AS (SELECT date, code, list(ret) OVER (PARTITION BY code ORDER BY date ROWS 11 PRECEDING) AS l FROM rets WHERE ret IS NOT NULL),
t AS (SELECT factor, date, code, l FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, code) AS k FROM m WHERE q = 5) JOIN l USING (date, code) WHERE k <= 10 AND len(l) = 12),
e AS (SELECT factor, date, code, unnest(range(12)) AS i, unnest(l) AS x FROM t), z AS (SELECT factor, date, i, (x - avg(x) OVER v) / stddev_pop(x) OVER v AS z FROM e WINDOW v AS (PARTITION BY factor, date, code)),
p AS (SELECT factor, date, i, count(*) AS n, sum(z) * sum(z) - sum(z * z) AS p FROM z GROUP BY 1, 2, 3), c AS (SELECT factor, date, CASE WHEN max(n) > 1 THEN sum(p) / (12 * max(n) * (max(n) - 1)) END AS corr FROM p GROUP BY 1, 2),
a AS (SELECT factor, date, spread, corr, turnover FROM s LEFT JOIN c USING (factor, date)),
y AS (SELECT *, """ + ", ".join(f"CASE WHEN count({x}) OVER v >= 20 AND min({x}) OVER v < max({x}) OVER v THEN ({x} - avg({x}) OVER v) / stddev_samp({x}) OVER v END AS z_{x}" for x in ("spread", "corr", "turnover")) + """ FROM a WINDOW v AS (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT factor, date, spread, corr, turnover, CASE WHEN len(list_filter([z_spread, z_corr, z_turnover], lambda x: x IS NOT NULL)) >= 2 THEN list_avg(list_filter([z_spread, z_corr, z_turnover], lambda x: x IS NOT NULL)) END AS crowding FROM y""", values=("spread", "corr", "turnover", "crowding"), digits=3)
add("MS_12_crowding_gate", lambda s, d: ic(s, d).where("h = 4").withColumn("rank_ic", F.round("rank_ic", 9)).withColumn("pct", ts.percentile_of("rank_ic", 40, 20, by=("factor",))).select("factor", "date", F.col("pct").alias("value"), (F.col("pct") >= 0.8).alias("alert"), (1 - 0.4 * F.col("pct")).alias("gate")), """SELECT factor, date, CASE WHEN count(rank_ic) OVER v >= 20 THEN len(list_filter(list(rank_ic) OVER v, lambda x: x <= rank_ic))::DOUBLE / count(rank_ic) OVER v END AS value, CASE WHEN count(rank_ic) OVER v >= 20 THEN len(list_filter(list(rank_ic) OVER v, lambda x: x <= rank_ic))::DOUBLE / count(rank_ic) OVER v END >= 0.8 AS alert,
1 - 0.4 * CASE WHEN count(rank_ic) OVER v >= 20 THEN len(list_filter(list(rank_ic) OVER v, lambda x: x <= rank_ic))::DOUBLE / count(rank_ic) OVER v END AS gate FROM (SELECT factor, date, round(rank_ic, 9) AS rank_ic FROM ic WHERE h = 4) WINDOW v AS (PARTITION BY factor ORDER BY date ROWS 39 PRECEDING)""", values=("value", "gate"))

# Scores
def _composite(s, d, *kept: str):
    """The mean of a row's ranks, those of mom_4 turned round; rows without any have none."""
    r = ranked(wide(panel.returns(B(s, d))), list(_DEF))
    signed = F.filter(F.array(*[F.col(n) * (-1 if n == "mom_4" else 1) for n in _DEF]), lambda x: x.isNotNull())
    mean = F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.size(signed)
    return r.where(F.size(signed) > 0).select("date", "code", *kept, mean.alias("score"))


CM = """, rk AS (SELECT *, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY factor, date) * CASE WHEN factor = 'mom_4' THEN -1 ELSE 1 END AS r FROM factors WHERE value IS NOT NULL),
cm AS (SELECT date, code, avg(r) AS score FROM rk GROUP BY 1, 2)
"""
add("CM_01_rank_composite", _composite, CM + "SELECT date, code, score FROM cm", values=("score",))


def _z_composite(s, d):
    w = s.createDataFrame([("mom_4", -0.5), ("vol_12", 0.3), ("size", 0.2)], "factor string, weight double")
    f = factors(s, d).withColumn("z", xs.zscore("value", ("factor", "date"))).where("z is not null").join(F.broadcast(w), "factor")
    return f.groupBy("date", "code").agg((F.sum(F.col("z") * F.col("weight")) / F.sum(F.abs("weight"))).alias("score"))


add("CM_02_z_composite", _z_composite, """, wt AS (SELECT * FROM (VALUES ('mom_4', -0.5), ('vol_12', 0.3), ('size', 0.2)) t(factor, weight)),
z AS (SELECT date, code, factor, (value - avg(value) OVER v) / nullif(stddev_samp(value) OVER v, 0) AS z FROM factors WHERE value IS NOT NULL WINDOW v AS (PARTITION BY factor, date))
SELECT date, code, sum(z * weight) / sum(abs(weight)) AS score FROM z JOIN wt USING (factor) WHERE z IS NOT NULL GROUP BY 1, 2""", values=("score",), digits=3)


def _preprocess(s, d):
    m = xs.winsorize_mad(factors(s, d).where("factor = 'size'"), "value", "w")
    return m.withColumn("z", xs.zscore("w")).select("date", "code", F.col("z").alias("value"))


add("CM_03_preprocess", _preprocess, """, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY date) AS m FROM factors WHERE factor = 'size'),
k AS (SELECT *, 1.4826 * quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY date) AS mad FROM m),
c AS (SELECT date, code, CASE WHEN mad > 0 THEN least(greatest(value, m - 3 * mad), m + 3 * mad) ELSE value END AS x FROM k)
SELECT date, code, CASE WHEN min(x) OVER v < max(x) OVER v THEN (x - avg(x) OVER v) / stddev_samp(x) OVER v END AS value FROM c WINDOW v AS (PARTITION BY date)""", digits=3)


def _blend(s, d):
    return _composite(s, d, "vol_12").where("vol_12 is not null").select("date", "code", (0.7 * F.col("score") + 0.3 * F.col("vol_12")).alias("score"))


add("CM_04_blend", _blend, CM + "SELECT cm.date, cm.code, 0.7 * score + 0.3 * r AS score FROM cm JOIN rk ON rk.date = cm.date AND rk.code = cm.code AND rk.factor = 'vol_12'", values=("score",))


def _walk_forward(s, d):
    """Per date the direction and weight of each factor from the ICs that ended 4 dates before, at least 20 of the last 52."""
    i = ic(s, d).where("h = 4").select("factor", "date", "rank_ic")
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-55, -4)
    i = i.withColumns({"n": F.count("rank_ic").over(w), "m": F.avg("rank_ic").over(w), "sd": F.stddev_samp("rank_ic").over(w)}).where("n >= 20 and sd > 0")
    weights = i.select("factor", "date", F.signum("m").alias("direction"), F.abs(F.col("m") / F.col("sd")).alias("weight"))
    z = factors(s, d).withColumn("z", xs.zscore("value", ("factor", "date"))).where("z is not null")
    return z.join(weights, ["factor", "date"]).groupBy("date", "code").agg((F.sum(F.col("z") * F.col("direction") * F.col("weight")) / F.sum("weight")).alias("score"))


add("WF_01_walk_forward", _walk_forward, """, i AS (SELECT factor, date, count(rank_ic) OVER v AS n, avg(rank_ic) OVER v AS m, stddev_samp(rank_ic) OVER v AS sd FROM ic WHERE h = 4 WINDOW v AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 55 PRECEDING AND 4 PRECEDING)),
wt AS (SELECT factor, date, sign(m) AS direction, abs(m / sd) AS weight FROM i WHERE n >= 20 AND sd > 0),
z AS (SELECT date, code, factor, (value - avg(value) OVER v) / nullif(stddev_samp(value) OVER v, 0) AS z FROM factors WHERE value IS NOT NULL WINDOW v AS (PARTITION BY factor, date))
SELECT date, code, sum(z * direction * weight) / sum(weight) AS score FROM z JOIN wt USING (factor, date) WHERE z IS NOT NULL GROUP BY 1, 2""", values=("score",), digits=3)
add("WF_02_splits", lambda s, d: ic(s, d).where("h = 4").withColumn("part", F.when(F.col("date") < "1999-01-01", "in").otherwise("out")).groupBy("factor", "part").agg(F.avg("rank_ic").alias("mean"), (F.avg("rank_ic") / F.stddev_samp("rank_ic")).alias("icir")), "SELECT factor, CASE WHEN date < DATE '1999-01-01' THEN 'in' ELSE 'out' END AS part, avg(rank_ic) AS mean, avg(rank_ic) / stddev_samp(rank_ic) AS icir FROM ic WHERE h = 4 GROUP BY 1, 2", dates=(), values=("mean", "icir"))


add("ML_01_features", features, """, rk AS (SELECT *, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY factor, date) AS r FROM factors WHERE value IS NOT NULL),
p AS (SELECT date, code, max(r) FILTER (WHERE factor = 'mom_4') AS mom_4, max(r) FILTER (WHERE factor = 'size') AS size, max(r) FILTER (WHERE factor = 'vol_12') AS vol_12 FROM rk GROUP BY 1, 2)
SELECT * FROM p WHERE mom_4 IS NOT NULL AND size IS NOT NULL AND vol_12 IS NOT NULL""", values=("mom_4", "size", "vol_12"))


def _boosted(s, d):
    """Boosted trees on the ranked factors up to 1998, scored after."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = ["mom_4", "size", "vol_12"]
    label = F.least(F.greatest(panel.forward_return("close", 4), F.lit(-0.5)), F.lit(0.5))
    x = ranked(wide(panel.returns(B(s, d)).withColumn("label", label), "label"), names, "label").na.drop(subset=names)
    # learning reads the table many times, so it is written once
    folder = fresh(s, "features")
    x.write.parquet(folder)
    m = VectorAssembler(inputCols=names, outputCol="features").transform(s.read.schema(x.schema).parquet(folder)).select("date", "code", "features", "label")
    fitted = GBTRegressor(maxIter=5, maxDepth=3, seed=1).fit(m.where("date < '1999-01-01' and label is not null"))
    return fitted.transform(m.where("date >= '1999-01-01'")).select("date", "code", F.round("prediction", 3).alias("score"))


add("ML_02_boosted", _boosted, None, values=())

# Point in time
_R = X.reports
C.add("PIT_01_effective_notice", lambda s, d: _R(s, d).select("code", "period", F.least("notice", F.date_add("period", 60)).alias("effective")), "SELECT code, period, least(notice, period + 60) AS effective FROM reports", dates=("period", "effective"), values=())
_KEEP = "ladder AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1)"
C.add("PIT_02_ladder", lambda s, d: asof.asof(B(s, d).select("code", "date", "close"), panel.latest(_R(s, d), ["code", "notice"], [F.desc("period")]), ["net_profit"], right_on="notice").select("code", "date", (F.col("net_profit") / F.col("close")).alias("value")), f"{_KEEP}\nSELECT b.code, b.date, net_profit / close AS value FROM bars b ASOF LEFT JOIN ladder l ON b.code = l.code AND b.date >= l.notice")


def _suppressed(s, d):
    later = F.min("notice").over(Window.partitionBy("code").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1))
    return _R(s, d).withColumn("later", later).where("later is null or later > notice").select("code", "period", "notice")


C.add("PIT_03_suppression", _suppressed, "SELECT code, period, notice FROM (SELECT *, min(notice) OVER (PARTITION BY code ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM reports) WHERE later IS NULL OR later > notice", dates=("period", "notice"), values=())
C.add("PIT_05_single_quarter", lambda s, d: _R(s, d).withColumn("cum", F.sum("revenue").over(Window.partitionBy("code", F.year("period")).orderBy("period"))).withColumns({"p": F.lag("cum").over(Window.partitionBy("code").orderBy("period")), "gap": F.months_between("period", F.lag("period").over(Window.partitionBy("code").orderBy("period")))}).select("code", "period", F.when(F.quarter("period") == 1, F.col("cum")).when(F.col("gap") == 3, F.col("cum") - F.col("p")).alias("value")), """c AS (SELECT *, sum(revenue) OVER (PARTITION BY code, year(period) ORDER BY period) AS cum FROM reports),
l AS (SELECT *, lag(cum) OVER w AS p, date_diff('month', lag(period) OVER w, period) AS gap FROM c WINDOW w AS (PARTITION BY code ORDER BY period))
SELECT code, period, CASE WHEN quarter(period) = 1 THEN cum WHEN gap = 3 THEN cum - p END AS value FROM l""", dates=("period",), digits=2)


def _diff(s, d):
    a = B(s, d).where("vol > 10").select("code", "date", F.col("close").alias("x"))
    b = B(s, d).where("vol < 90").select("code", "date", (F.col("close") + F.when(F.col("code") == "3", 0.5).otherwise(0.0)).alias("y"))
    j = a.join(b, ["code", "date"], "full").withColumn("e", F.abs(F.col("x") - F.col("y")))
    return j.agg(F.count(F.when(F.col("y").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("e") > 1e-9, 1)).alias("bad"), F.max("e").alias("value"))


C.add("PIT_08_diff", _diff, """a AS (SELECT code, date, close AS x FROM bars WHERE vol > 10), b AS (SELECT code, date, close + CASE WHEN code = '3' THEN 0.5 ELSE 0 END AS y FROM bars WHERE vol < 90)
SELECT count(*) FILTER (WHERE y IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL) AS only_right, count(*) FILTER (WHERE abs(x - y) > 1e-9) AS bad, max(abs(x - y)) AS value FROM a FULL JOIN b USING (code, date)""", dates=())


def _structure(s, d):
    f = factors(s, d)
    whole = f.groupBy("factor").agg(F.count("*").alias("rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"), F.countDistinct("date").alias("dates"), F.avg((F.col("value") != 0).cast("double")).alias("nonzero"))
    return whole.join(xs.quantiles(f.withColumn("_size", F.abs("value")), "_size", {"q99": 0.99}, "factor"), "factor", "left")


add("PIT_09_structure", _structure, "SELECT factor, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls, count(DISTINCT date) AS dates, avg(CAST(value <> 0 AS INTEGER)) AS nonzero, quantile_cont(abs(value), 0.99) AS q99 FROM factors GROUP BY 1", dates=(), values=("nonzero", "q99"))
add("PIT_10_verdict", lambda s, d: factors(s, d).groupBy("factor").agg(F.avg(F.col("value").isNull().cast("double")).alias("n")).select("factor", F.when(F.col("n") > 0.5, "FAIL").when(F.col("n") > 0.005, "WARN").otherwise("PASS").alias("verdict")), "SELECT factor, CASE WHEN avg(CAST(value IS NULL AS INTEGER)) > 0.5 THEN 'FAIL' WHEN avg(CAST(value IS NULL AS INTEGER)) > 0.005 THEN 'WARN' ELSE 'PASS' END AS verdict FROM factors GROUP BY 1", dates=(), values=())
C.add("PIT_13_period_from_notice", lambda s, d: _R(s, d).select("notice").distinct().select("notice", F.last_day(F.add_months(F.trunc("notice", "quarter"), -1)).alias("period")), "SELECT DISTINCT notice, CAST(date_trunc('quarter', notice) AS DATE) - 1 AS period FROM reports", dates=("notice", "period"), values=())

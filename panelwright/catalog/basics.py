"""Panels, time series, cross sections and element-wise functions on weekly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.functions import elementwise as el
from panelwright.operators import kernels, panel, ts, xs

C = Q = X.Catalog()


def _bars(spark, sf):
    return X.bars(spark, sf)


def series(name: str, column, body: str, prepare=None) -> None:
    """A column over bars: code, date and value rounded to 6 digits. body: the same over `b`, with window w along the code."""

    def run(spark, sf):
        d = _bars(spark, sf)
        d = prepare(d) if prepare else d
        return d.select("code", "date", column().alias("value"))

    C.add(name, run, f"SELECT code, date, {body} AS value FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)")


def framed(fn: str, d: int, x: str = "close", least: int | None = None) -> str:
    f = f"OVER (w ROWS {d - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} >= {d if least is None else least} THEN {fn.format(x=x)} {f} END"


# Time series
series("TS_01_delay", lambda: ts.delay("close", 3), "lag(close, 3) OVER w")
series("TS_02_delta", lambda: ts.delta("close", 2), "close - lag(close, 2) OVER w")
series("TS_03_mean", lambda: ts.mean("close", 6), framed("avg({x})", 6))
series("TS_04_std", lambda: ts.std("close", 6), framed("stddev_samp({x})", 6))
series("TS_05_sum", lambda: ts.total("vol", 6), framed("sum({x})", 6, "vol"))
series("TS_06_min_max", lambda: ts.high("high", 6) - ts.low("low", 6), f"{framed('max({x})', 6, 'high')} - {framed('min({x})', 6, 'low')}")
series("TS_07_rank", lambda: ts.rank("vol", 10), "CASE WHEN count(vol) OVER (w ROWS 9 PRECEDING) >= 10 THEN (len(list_filter(list(vol) OVER (w ROWS 9 PRECEDING), lambda v: v < vol)) + (len(list_filter(list(vol) OVER (w ROWS 9 PRECEDING), lambda v: v = vol)) + 1) / 2.0) / 10 END")
_FRAME9 = "OVER (w ROWS 9 PRECEDING)"
_VARIES = f"min(close) {_FRAME9} < max(close) {_FRAME9} AND min(vol) {_FRAME9} < max(vol) {_FRAME9} AND count(close) {_FRAME9} >= 10"
series("TS_08_corr", lambda: ts.corr("close", "vol", 10), f"CASE WHEN {_VARIES} THEN corr(close, vol) {_FRAME9} END")
series("TS_09_cov", lambda: ts.cov("close", "vol", 10), f"CASE WHEN count(close) {_FRAME9} >= 10 THEN covar_samp(close, vol) {_FRAME9} END")
series("TS_10_argmax", lambda: ts.argmax("high", 8), "CASE WHEN count(high) OVER (w ROWS 7 PRECEDING) >= 8 THEN list_position(list(high) OVER (w ROWS 7 PRECEDING), max(high) OVER (w ROWS 7 PRECEDING)) - 1 END")
series("TS_10_argmin", lambda: ts.argmin("low", 8), "CASE WHEN count(low) OVER (w ROWS 7 PRECEDING) >= 8 THEN list_position(list(low) OVER (w ROWS 7 PRECEDING), min(low) OVER (w ROWS 7 PRECEDING)) - 1 END")
series("TS_11_decay_linear", lambda: ts.decay_linear("close", 4), "(4 * close + 3 * lag(close, 1) OVER w + 2 * lag(close, 2) OVER w + lag(close, 3) OVER w) / 10.0")
series("TS_12_slope", lambda: ts.slope("close", "vol", 12), "CASE WHEN count(*) OVER (w ROWS 11 PRECEDING) >= 8.4 AND min(vol) OVER (w ROWS 11 PRECEDING) < max(vol) OVER (w ROWS 11 PRECEDING) THEN regr_slope(close, vol) OVER (w ROWS 11 PRECEDING) END")
series("TS_13_zscore", lambda: ts.zscore("close", 20, 10), "CASE WHEN count(close) OVER (w ROWS 19 PRECEDING) >= 10 AND min(close) OVER (w ROWS 19 PRECEDING) < max(close) OVER (w ROWS 19 PRECEDING) THEN (close - avg(close) OVER (w ROWS 19 PRECEDING)) / stddev_samp(close) OVER (w ROWS 19 PRECEDING) END")
series("TS_14_percentile", lambda: ts.percentile_of("vol", 20, 10), "CASE WHEN count(vol) OVER (w ROWS 19 PRECEDING) >= 10 THEN len(list_filter(list(vol) OVER (w ROWS 19 PRECEDING), lambda v: v <= vol))::DOUBLE / count(vol) OVER (w ROWS 19 PRECEDING) END")
series("TS_15_quantile", lambda: ts.quantile("vol", 20, 0.8, 15), "CASE WHEN count(vol) OVER (w ROWS 19 PRECEDING) >= 15 THEN quantile_cont(vol, 0.8) OVER (w ROWS 19 PRECEDING) END")
series("TS_16_event_count", lambda: ts.total(F.when(F.col("vol") > 60, 1).otherwise(0), 20, 15), "CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 15 THEN sum(CASE WHEN vol > 60 THEN 1 ELSE 0 END) OVER (w ROWS 19 PRECEDING) END")
series("TS_17_conditional", lambda: ts.mean(F.when(F.col("high") > F.col("low"), F.col("close")), 12, 3), "CASE WHEN count(CASE WHEN high > low THEN close END) OVER (w ROWS 11 PRECEDING) >= 3 THEN avg(CASE WHEN high > low THEN close END) OVER (w ROWS 11 PRECEDING) END")
series("TS_18_lagged_window", lambda: ts.rolling("close", 12, "avg", 6, last=-1), "CASE WHEN count(close) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) >= 6 THEN avg(close) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END")
series("TS_23_last_known", lambda: ts.last_known(F.when(F.col("high") > F.col("low"), F.col("close"))), "last_value(CASE WHEN high > low THEN close END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING)")
series("TS_25_drawdown", lambda: ts.drawdown("close"), "close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1")
series("TS_26_compounded", lambda: ts.compounded(F.col("vol") / 10000), "exp(sum(ln(1 + vol / 10000)) OVER (w ROWS UNBOUNDED PRECEDING))")
series("TS_21_survival", lambda: ts.survival(F.col("vol") / 10000), "exp(sum(ln(1 - vol / 10000)) OVER (w ROWS UNBOUNDED PRECEDING))")

_QUARTER = "year(date) * 4 + quarter(date)"
C.add("TS_19_value_range", lambda s, d: _bars(s, d).withColumn("q", (F.year("date") * 4 + F.quarter("date")).cast("int")).select("code", "date", (F.avg("close").over(ts.Window.partitionBy("code").orderBy("q").rangeBetween(-8, -1))).alias("value")),
      f"SELECT code, date, (avg(close) OVER (PARTITION BY code ORDER BY {_QUARTER} RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS value FROM bars")
C.add("TS_20_calendar_frame", lambda s, d: _bars(s, d).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date"))).select("code", "date", F.sum("vol").over(ts.Window.partitionBy("code").orderBy("day").rangeBetween(-20, 0)).alias("value")),
      "SELECT code, date, sum(vol) OVER (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND CURRENT ROW) AS value FROM bars")


def _held_cost(s, d):
    b = _bars(s, d).withColumn("u", F.col("vol") / 2000)
    return ts.held_cost(b, "close", "u", "cost", block=60).select("code", "date", F.col("cost").alias("value"))


C.add("TS_22_held_cost", _held_cost, """o AS (SELECT code, date, close AS p, CASE WHEN row_number() OVER v = 1 THEN 1.0 ELSE least(vol / 2000, 1) END AS u, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
r AS (SELECT code, date, p AS c, i FROM o WHERE i = 1
      UNION ALL SELECT o.code, o.date, r.c * (1 - o.u) + o.p * o.u, o.i FROM r JOIN o ON o.code = r.code AND o.i = r.i + 1)
SELECT code, date, (c) AS value FROM r""")
C.oracle["TS_22_held_cost"] = C.oracle["TS_22_held_cost"].replace("WITH ", "WITH RECURSIVE ", 1)
C.add("TS_24_ordered_map", lambda s, d: _bars(s, d).groupBy("code").applyInPandas(kernels.smoothed, "code string, date date, value double"))


def _ewma(s, d):
    w = ts.Window.partitionBy("code").orderBy(F.desc("date"))
    b = _bars(s, d).withColumn("k", F.row_number().over(w) - 1).where("k < 60").withColumn("wt", F.pow(F.lit(0.5), F.col("k") / 20))
    return b.groupBy("code").agg((F.sum(F.col("wt") * F.col("close")) / F.sum("wt")).alias("value"))


C.add("TS_27_ewma", _ewma, """k AS (SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) - 1 AS k FROM bars)
SELECT code, (sum(pow(0.5, k / 20.0) * close) / sum(pow(0.5, k / 20.0))) AS value FROM k WHERE k < 60 GROUP BY code""", dates=())


def _runs(s, d):
    b = _bars(s, d).withColumn("up", F.coalesce(F.signum(F.col("close") - ts.delay("close")), F.lit(0.0)))
    return ts.runs(b, F.col("up")).groupBy("code").agg(F.max("run_length").alias("longest"), F.max("run").alias("runs"))


C.add("TS_28_runs", _runs, """s AS (SELECT code, date, coalesce(sign(close - lag(close) OVER (PARTITION BY code ORDER BY date)), 0) AS up FROM bars),
n AS (SELECT code, date, CASE WHEN up IS NOT DISTINCT FROM lag(up) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY code ORDER BY date)),
r AS (SELECT code, sum(new) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM n),
c AS (SELECT code, run, count(*) AS n FROM r GROUP BY 1, 2) SELECT code, max(n) AS longest, CAST(max(run) AS BIGINT) AS runs FROM c GROUP BY code""", dates=(), values=())


def _cooled(s, d):
    b = _bars(s, d).withColumn("flag", F.col("vol") > 80)
    return ts.cooled_down(b, "flag", 4).where("kept").select("code", "date")


C.add("TS_28_cooled_down", _cooled, """e AS (SELECT code, date, vol, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM bars),
f AS (SELECT code, date, i FROM e WHERE vol > 80),
k AS (SELECT code, date, i FROM f WHERE i = (SELECT min(g.i) FROM f g WHERE g.code = f.code)
      UNION ALL SELECT code, date, i FROM (SELECT f.code, f.date, f.i, row_number() OVER (PARTITION BY f.code ORDER BY f.i) AS r FROM k JOIN f ON f.code = k.code AND f.i > k.i + 4) WHERE r = 1)
SELECT code, date FROM k""", values=())
C.oracle["TS_28_cooled_down"] = C.oracle["TS_28_cooled_down"].replace("WITH ", "WITH RECURSIVE ", 1)


def section(name: str, column, body: str) -> None:
    C.add(name, lambda s, d: _bars(s, d).select("code", "date", column().alias("value")), f"SELECT code, date, {body} AS value FROM bars WINDOW w AS (PARTITION BY date)")


# Cross sections
section("XS_01_rank_pct", lambda: xs.rank_pct("vol"), "(rank() OVER (PARTITION BY date ORDER BY vol) + (count(*) OVER (PARTITION BY date, vol) - 1) / 2.0) / count(vol) OVER w")
section("XS_02_rank", lambda: xs.rank("vol"), "rank() OVER (PARTITION BY date ORDER BY vol)")
section("XS_03_scale", lambda: xs.scale("close", 2.0), "close * 2 / nullif(sum(abs(close)) OVER w, 0)")
section("XS_04_zscore", lambda: xs.zscore("close"), "CASE WHEN min(close) OVER w < max(close) OVER w THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END")
section("XS_07_ntile", lambda: xs.ntile("vol", 5), "ntile(5) OVER (PARTITION BY date ORDER BY vol, code)")
section("XS_08_percent_rank", lambda: xs.percent_rank("vol"), "percent_rank() OVER (PARTITION BY date ORDER BY vol)")
section("XS_13_rank_product", lambda: xs.rank_product("vol", "close"), "rank() OVER (PARTITION BY date ORDER BY vol) * rank() OVER (PARTITION BY date ORDER BY close)")
section("XS_15_distance", lambda: F.abs(xs.zscore("close")), "CASE WHEN min(close) OVER w < max(close) OVER w THEN abs((close - avg(close) OVER w) / stddev_samp(close) OVER w) END")
section("XS_11_residual", lambda: xs.residual("close", "vol"), "CASE WHEN count(*) OVER w >= 3 THEN close - avg(close) OVER w - coalesce(covar_samp(close, vol) OVER w / nullif(var_samp(vol) OVER w, 0), 0) * (vol - avg(vol) OVER w) END")
C.add("XS_05_winsorize", lambda s, d: xs.winsorize_mad(_bars(s, d), "vol", "value").select("code", "date", F.col("value").alias("value")), """m AS (SELECT *, quantile_cont(vol, 0.5) OVER (PARTITION BY date) AS m FROM bars),
k AS (SELECT *, quantile_cont(abs(vol - m), 0.5) OVER (PARTITION BY date) * 1.4826 AS mad FROM m)
SELECT code, date, (CASE WHEN mad > 0 THEN least(greatest(vol, m - 3 * mad), m + 3 * mad) ELSE vol END) AS value FROM k""")
C.add("XS_06_qcut", lambda s, d: xs.qcut(_bars(s, d), "vol", "value", 5).select("code", "date", F.col("value").cast("int").alias("value")), """e AS (SELECT *, list_distinct(quantile_cont(vol, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY date)) AS e FROM bars)
SELECT code, date, CAST(CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda x: x < vol)) - 1, 0) END AS INTEGER) AS value FROM e""")
C.add("XS_09_neutralize", lambda s, d: xs.neutralize(_bars(s, d).join(X.groups(s, d), "code"), "close", "amount", "coarse", "value", least=5).select("code", "date", F.col("value").alias("value")), """d AS (SELECT code, date, close AS y, ln(amount) AS x, coarse FROM bars JOIN groups USING (code)),
m AS (SELECT code, date, y - avg(y) OVER g AS y, x - avg(x) OVER g AS x FROM d WINDOW g AS (PARTITION BY date, coarse))
SELECT code, date, (CASE WHEN count(*) OVER w >= 5 THEN y - coalesce(sum(x * y) OVER w / nullif(sum(x * x) OVER w, 0), 0) * x END) AS value FROM m WINDOW w AS (PARTITION BY date)""")
C.add("XS_10_residual_styles", lambda s, d: xs.residual_many(_bars(s, d).withColumns({"a": xs.rank_pct("amount"), "b": xs.rank_pct("vol")}), "close", ["a", "b"], "value", least=20).select("code", "date", F.col("value").alias("value")))


def _domain(s, d):
    b = _bars(s, d).withColumn("half", F.when(F.col("amount") >= F.percentile("amount", F.lit(0.5)).over(xs.section()), 1).otherwise(0))
    return b.select("code", "date", (xs.rank_pct("close", ("date", "half"))).alias("value"))


C.add("XS_12_domain_rank", _domain, """h AS (SELECT *, CASE WHEN amount >= quantile_cont(amount, 0.5) OVER (PARTITION BY date) THEN 1 ELSE 0 END AS half FROM bars)
SELECT code, date, ((rank() OVER (PARTITION BY date, half ORDER BY close) + (count(*) OVER (PARTITION BY date, half, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date, half)) AS value FROM h""")


def _gap(s, d):
    b = _bars(s, d).withColumn("gap", F.col("close") - F.percentile("close", F.lit(0.5)).over(xs.section()))
    return b.select("code", "date", (ts.mean("gap", 20, 15)).alias("value"))


C.add("XS_14_gap_to_median", _gap, """g AS (SELECT *, close - quantile_cont(close, 0.5) OVER (PARTITION BY date) AS gap FROM bars)
SELECT code, date, (CASE WHEN count(gap) OVER w >= 15 THEN avg(gap) OVER w END) AS value FROM g WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""")

# Element-wise
_R = "(close - lag(close) OVER w)"
_r = lambda: ts.delta("close")
series("EL_01_sign_abs", lambda: F.signum(_r()) * F.abs(_r()), f"sign({_R}) * abs({_R})")
series("EL_02_guarded_log", lambda: el.guarded_log(_r()), f"CASE WHEN {_R} > 0 THEN ln({_R}) END")
series("EL_03_if_else", lambda: el.if_else(_r() > 0, F.lit(1.0), F.lit(-1.0)), f"CASE WHEN {_R} > 0 THEN 1.0 ELSE -1.0 END")
series("EL_04_pair_max_min", lambda: el.pair_max(_r(), F.lit(0.0)) + 2 * el.pair_min(_r(), F.lit(0.0)), f"CASE WHEN {_R} IS NOT NULL THEN greatest({_R}, 0) + 2 * least({_R}, 0) END")
series("EL_05_guarded_pow", lambda: el.guarded_pow(_r(), 0.5), f"CASE WHEN {_R} >= 0 THEN pow({_R}, 0.5) END")
series("EL_06_safe_div", lambda: el.safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), "(close - low) / nullif(high - low, 0)")
series("EL_07_clip", lambda: el.clip(_r(), -50.0, 50.0), f"CASE WHEN {_R} IS NOT NULL THEN least(greatest({_R}, -50), 50) END")

# Panels
C.add("PNL_01_adjusted", lambda s, d: panel.adjusted(_bars(s, d).withColumn("adj_factor", F.lit(1.5))).select("code", "date", F.col("open").alias("open"), F.col("close").alias("close"), F.col("vwap").alias("vwap"), "vol"),
      "SELECT code, date, (open * 1.5) AS open, (close * 1.5) AS close, (amount / vol * 1.5) AS vwap, vol FROM bars", values=("open", "close", "vwap"))
C.add("PNL_02_valid", lambda s, d: panel.valid(_bars(s, d)).select("code", "date", "close"), "SELECT code, date, close FROM bars WHERE close > 0 AND vol > 0", values=("close",))
C.add("PNL_03_dense", lambda s, d: panel.dense(_bars(s, d).select("code", "date", "close")), "SELECT c.code, d.date, b.close FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.code = c.code AND b.date = d.date", values=("close",))
C.add("PNL_04_long_finite", lambda s, d: _bars(s, d).select("code", "date", (el.finite(el.safe_div(F.col("amount"), F.col("high") - F.col("low")))).alias("value")).where("value is not null"), "SELECT code, date, (amount / (high - low)) AS value FROM bars WHERE high > low")
C.add("PNL_05_members", lambda s, d: panel.members_only(_bars(s, d), X.groups(s, d).where("coarse = '1'").select("code")).select("code", "date", "close"), "SELECT code, date, close FROM bars WHERE code IN (SELECT code FROM groups WHERE coarse = '1')", values=("close",))
series("PNL_06_forward", lambda: panel.forward_return("close", 4), "CASE WHEN close > 0 THEN lead(close, 4) OVER w / close - 1 END")
C.add("PNL_07_forward_on_factor", lambda s, d: _bars(s, d).where("high > low").select("code", "date", (panel.forward_return("close", 4)).alias("value")), "SELECT code, date, (lead(close, 4) OVER (PARTITION BY code ORDER BY date) / close - 1) AS value FROM bars WHERE high > low")
C.add("PNL_08_forward_many", lambda s, d: panel.forward_returns(_bars(s, d), (1, 4, 12)).select("code", "date", *[F.col(f"fwd_{h}").alias(f"fwd_{h}") for h in (1, 4, 12)]), "SELECT code, date, (lead(close, 1) OVER w / close - 1) AS fwd_1, (lead(close, 4) OVER w / close - 1) AS fwd_4, (lead(close, 12) OVER w / close - 1) AS fwd_12 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)", values=("fwd_1", "fwd_4", "fwd_12"))
C.add("PNL_09_returns", lambda s, d: panel.returns(_bars(s, d)).select("code", "date", *[F.col(c).alias(c) for c in ("ret", "overnight", "intraday")]), "SELECT code, date, (close / lag(close) OVER w - 1) AS ret, (open / lag(close) OVER w - 1) AS overnight, (close / open - 1) AS intraday FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)", values=("ret", "overnight", "intraday"))
series("PNL_10_unlocked", lambda: panel.unlocked(F.col("close")), "CASE WHEN high > low THEN close END")
series("PNL_11_executable", lambda: panel.executable_return(3), "CASE WHEN NOT coalesce(lead(high) OVER w = lead(low) OVER w AND lead(close) OVER w / close - 1 >= 0.07, false) THEN lead(close, 3) OVER w / lead(open) OVER w - 1 END")
C.add("CAL_01_calendar", lambda s, d: panel.calendar(_bars(s, d)), "SELECT trade_date, row_number() OVER w AS n, lag(trade_date) OVER w AS previous, lead(trade_date) OVER w AS next, year(trade_date) AS year, month(trade_date) AS month, weekofyear(trade_date) AS week FROM (SELECT DISTINCT date AS trade_date FROM bars) WINDOW w AS (ORDER BY trade_date)", dates=("trade_date", "previous", "next"), values=())

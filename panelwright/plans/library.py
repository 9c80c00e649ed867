"""The named factors, with what each reads and how far back.

Tables (code and a date, unless said otherwise):

* bars: open, high, low, close, vol, amount; flow: main_net; flows: small_net, net_amount, on the same rows
* capital: float_shares, total_shares from a date on; groups: balance, no date
* items and reports: statements by period and notice, q (the quarter's number) in items; forecasts by known
* actions: cash by day; seats: seat and net by day; blocks: price and amount by day
* minutes: bars by datetime and date
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.elementwise import clip, safe_div
from panelwright.operators import asof, panel, ts, xs
from panelwright.plans import evaluate, formulas
from panelwright.plans import fundamentals as fu
from panelwright.plans import minutes as mi
from panelwright.plans import reports as rp
from panelwright.plans.registry import Factor, Reach, Registry, Table

c = F.col
#: Bars that a day of minutes needs to count, and codes that a section of composites needs.
DAY_BARS, SECTION = 30, 30


def _traded(get) -> DataFrame:
    keys = ["code", "date"]
    return get["bars"].select(*keys).join(get["flow"].select(*keys), keys, "left_semi").join(get["flows"].select(*keys), keys, "left_semi")


def _full_days(get) -> DataFrame:
    """Days of enough bars whose price moves: those that minute factors average."""
    d = get["minutes"].where("close > 0").groupBy("code", "date").agg(F.count("*").alias("n"), F.min("close").alias("a"), F.max("close").alias("b"))
    return d.where((c("n") >= DAY_BARS) & (c("a") < c("b")))


LIBRARY = Registry([
    Table("bars"), Table("flow", calendar=_traded), Table("flows", calendar=_traded), Table("minutes", calendar=_full_days), Table("actions", rule="events", announced=60), Table("seats", rule="events", late=True), Table("blocks", rule="events", late=True),
    Table("capital", rule="published"), Table("items", "notice", "published"), Table("reports", "notice", "published"), Table("forecasts", "known", "published"), Table("groups", None),
])


# Frames
@LIBRARY.frame("priced", "bars", reach=Reach(1, 1))
def _priced(get):
    """Bars with returns and gaps."""
    return panel.returns(get["bars"])


@LIBRARY.frame("moved", "bars", "flow", "flows", reach=Reach(1, 1), staged=True)
def _moved(get):
    """Bars with flows and returns."""
    return panel.returns(get["bars"].join(get["flow"], ["code", "date"]).join(get["flows"], ["code", "date"]))


@LIBRARY.frame("panel", "moved", "capital")
def _panel(get):
    """Bars with flows, returns, the shares of the date, turnover and the market's mean return: a row a date from a second reading where what it comes from is stored, else a window over whole rows."""
    p = asof.asof(get["moved"], get["capital"], ["float_shares", "total_shares"]).withColumn("turnover", c("vol") * 100 / c("float_shares"))
    if get.stands("moved"):
        return p.join(F.broadcast(get["moved"].groupBy("date").agg(F.avg("ret").alias("mkt"))), "date")
    return p.withColumn("mkt", F.avg("ret").over(xs.section()))


@LIBRARY.frame("moving", "priced", reach=Reach(None))
def _moving(get):
    """Rows whose last 20 returns vary, with the cube of the standardised return."""
    p = get["priced"].withColumns({"_m": ts.mean("ret", 20, 1), "_s": ts.std("ret", 20, 1), "_v": ts.low("ret", 20, 1) < ts.high("ret", 20, 1)})
    return p.where("_v").withColumn("_z", F.pow((c("ret") - c("_m")) / c("_s"), F.lit(3)))


TTM, YEAR = ("revenue", "net_profit", "operate_cf", "gross_profit", "one_off"), ("revenue", "net_profit", "total_assets")


@LIBRARY.frame("statements", "items")
def _statements(get):
    """Statements with sums over four quarters and the items of the year before."""
    return fu.a_year_before(fu.trailing(get["items"], list(TTM)), list(YEAR))


@LIBRARY.frame("merged", "statements")
def _merged(get):
    """Income, balance and cash statements that are published apart, as of the last."""
    return fu.merged(get["statements"], {"income": (0, ["net_profit_ttm", "gross_profit_ttm"]), "balance": (5, ["total_assets"]), "cash": (3, ["operate_cf_ttm"])})


def _wide(items: DataFrame, values: dict[str, Callable[[], Column]]) -> DataFrame:
    """(code, known, a column a value): the ladder of all values at once; which periods stay doesn't depend on the value."""
    row = fu.ladder(items, F.struct(*[v().cast("double").alias(n) for n, v in values.items()]))
    return row.select("code", "known", "value.*")


RATIOS: dict[str, tuple[str, Callable[[], Column]]] = {}


def _ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: safe_div(c(a), c(b))


for _n, _a, _b in (("roa", "net_profit", "total_assets"), ("net_margin", "net_profit", "revenue"), ("asset_turnover", "revenue", "total_assets"), ("roe", "net_profit", "total_equity"), ("debt_ratio", "total_liab", "total_assets"), ("ocf_ratio", "operate_cf", "net_profit"), ("op_margin", "op_profit", "revenue"), ("goodwill_ratio", "goodwill", "total_equity")):
    RATIOS[_n] = ("items", _ratio(_a, _b))
RATIOS |= {
    "current_ratio": ("items", lambda: c("current_ratio")),
    "quick_ratio": ("items", lambda: c("current_ratio") - safe_div(c("inventory"), c("total_liab"))),
    "accruals": ("items", lambda: safe_div(c("net_profit") - c("operate_cf"), c("total_assets"))),
    "profit_growth_yoy": ("statements", lambda: fu.growth("net_profit")), "asset_growth_yoy": ("statements", lambda: fu.growth("total_assets")),
    "np_q_yoy": ("statements", lambda: fu.growth("net_profit")), "rev_q_yoy": ("statements", lambda: fu.growth("revenue")),
    "roe_ttm": ("statements", _ratio("net_profit_ttm", "total_equity")),
    "roe_cut": ("statements", lambda: safe_div(c("net_profit_ttm") - c("one_off_ttm"), c("total_equity"))),
    "roic": ("statements", lambda: safe_div(c("net_profit_ttm"), c("total_equity") + c("total_liab"))),
    "gpoa": ("merged", _ratio("gross_profit_ttm", "total_assets")),
    "accruals2": ("merged", lambda: safe_div(F.coalesce("net_profit_ttm", F.lit(0.0)) - F.coalesce("operate_cf_ttm", F.lit(0.0)), c("total_assets"))),
    "ocf_to_profit": ("merged", _ratio("operate_cf_ttm", "net_profit_ttm")),
}


def _on_bars(source: str):
    """The ladder of all ratios of a source, carried along the bars in one as-of join."""
    names = [n for n, (s, _) in RATIOS.items() if s == source]

    def build(get):
        return asof.asof_each(get["bars"].select("code", "date"), _wide(get[source], {n: RATIOS[n][1] for n in names}), names, right_on="known")

    LIBRARY.frame(f"{source}_on_bars", "bars", source)(build)
    for n in names:
        LIBRARY.add(Factor(n, {f"{source}_on_bars": (n,)}, "statement", column=lambda n=n: c(n), reach=Reach()))


for _s in ("items", "statements", "merged"):
    _on_bars(_s)


def _valued(name: str, source: str, item: str, invert: bool = False) -> None:
    """item over market value; invert: as one over the ratio of market value to the item, null where that is 0."""

    def build(get):
        value = safe_div(F.lit(1.0), safe_div(c("mv"), c("value"))) if invert else safe_div(c("value"), c("mv"))
        return asof.asof(get["capitalised"], fu.ladder(get[source], c(item)).where("value is not null"), ["value"], right_on="known").select("code", "date", value.alias("value"))

    LIBRARY.add(Factor(name, {"capitalised": ("mv",), source: (item,)}, "value", build=build, reach=Reach()))


@LIBRARY.frame("capitalised", "bars", "capital")
def _capitalised(get):
    """Market value in tens of thousands."""
    p = asof.asof(get["bars"], get["capital"], ["total_shares"])
    return p.select("code", "date", (c("close") * c("total_shares") / 10000).alias("mv"))


for _n, _s, _x, _i in (("bp_report", "items", "total_equity", False), ("sp_report", "items", "revenue", False), ("ocfp_report", "items", "operate_cf", False), ("ep", "statements", "net_profit_ttm", True), ("bp", "statements", "total_equity", True), ("sp_ttm", "statements", "revenue_ttm", False), ("cfp_ttm", "statements", "operate_cf_ttm", False)):
    _valued(_n, _s, _x, _i)


@LIBRARY.frame("earning", "capitalised", "statements")
def _earning(get):
    """Earnings of four quarters over market value."""
    p = asof.asof(get["capitalised"], fu.ladder(get["statements"], c("net_profit_ttm")).where("value is not null"), ["value"], right_on="known")
    return p.select("code", "date", safe_div(c("value"), c("mv")).alias("ep"))


# Expressions
def put(name: str, on: str, rows: int | None, column: Callable[[], Column], *steps: dict, category: str = "price", reads: tuple[str, ...] = (), **about) -> None:
    LIBRARY.add(Factor(name, {on: reads}, category, column=column, steps=steps, reach=Reach(rows), **about))


for _d in (20, 60, 120):
    put(f"momentum_{_d}", "priced", _d, lambda d=_d: ts.change("close", d), reads=("close",))
for _d in (5, 10):
    put(f"reversal_{_d}", "priced", _d, lambda d=_d: -ts.change("close", d), reads=("close",))
for _d in (20, 60):
    put(f"volatility_{_d}", "priced", _d - 1, lambda d=_d: ts.std("ret", d, 2), reads=("ret",))
put("rsi_14", "priced", 14, lambda: F.when(ts.mean("_loss", 14, 1) == 0, 100.0).otherwise(100 - 100 / (1 + ts.mean("_gain", 14, 1) / ts.mean("_loss", 14, 1))),
    {"_gain": lambda: F.coalesce(F.greatest(ts.delta("close"), F.lit(0.0)), F.lit(0.0)), "_loss": lambda: F.coalesce(F.greatest(-ts.delta("close"), F.lit(0.0)), F.lit(0.0))}, reads=("close",))
put("amplitude_20", "priced", 19, lambda: ts.mean((c("high") - c("low")) / c("close"), 20, 1), reads=("high", "low", "close"))
put("max_return_20", "priced", 19, lambda: ts.high("ret", 20, 1), reads=("ret",))
for _d in (50, 250):
    put(f"price_position_{_d}", "priced", _d - 1, lambda d=_d: c("close") / ts.high("close", d, 1), reads=("close",))
put("downside_volatility_20", "priced", 19, lambda: F.sqrt(ts.mean(F.pow(F.least("ret", F.lit(0.0)), F.lit(2)), 20, 10)), reads=("ret",))
put("skewness_20", "moving", 19, lambda: ts.mean("_z", 20, 1), reads=("ret",))
put("size", "priced", 0, lambda: F.ln(c("close") * 1000), reads=("close",))
put("amihud_20", "priced", 19, lambda: ts.mean(F.abs("ret") / (c("amount") / 1e6), 20, 10), category="liquidity", reads=("ret", "amount"))
put("amount_std_20", "priced", 19, lambda: safe_div(ts.std("amount", 20, 10), ts.mean("amount", 20, 10)), category="liquidity", reads=("amount",))
put("amount_z_20", "priced", 19, lambda: clip(ts.zscore("amount", 20, 10), -2.0, 2.0), category="liquidity", reads=("amount",))
put("kyle_lambda_24", "priced", 23, lambda: ts.slope("ret", "vol", 24, 0.5), category="liquidity", reads=("ret", "vol"))
_PARK = {"_park": lambda: 0.5 * F.pow(F.ln(c("high") / c("low")), F.lit(2))}
put("volvol_20", "priced", 19, lambda: safe_div(ts.std("_park", 20, 15), ts.mean("_park", 20, 15)), _PARK, category="behaviour", reads=("high", "low"))
put("overnight_mom_20", "priced", 19, lambda: ts.mean(panel.unlocked(c("overnight")), 20, 8), category="behaviour", reads=("overnight", "high", "low"))


def _anchor(d: int) -> Column:
    return F.when(ts.change("close", 10) > 0, c("close") / ts.low("close", d, 1) - 1).otherwise(c("close") / ts.high("close", d, 1) - 1)


put("anchor_reversal_30", "priced", 29, lambda: _anchor(30), category="behaviour", reads=("close",))
put("anchor_reversal_20", "priced", 59, lambda: _anchor(60), category="behaviour", reads=("close",))
put("anchor_rev_vol_20", "priced", 59, lambda: _anchor(60) * ts.std("ret", 20, 2), category="behaviour", reads=("close", "ret"))

put("total_mcap", "panel", 0, lambda: F.ln(c("close") * c("total_shares") / 1e8), category="value", reads=("close", "total_shares"))
put("turnover", "panel", 0, lambda: c("turnover"), category="liquidity", reads=("turnover",))
put("turnover_std_20", "panel", 19, lambda: safe_div(ts.std("turnover", 20, 10), ts.mean("turnover", 20, 10)), category="liquidity", reads=("turnover",))
put("avg_amount_20", "panel", 19, lambda: ts.mean("amount", 20, 1), category="liquidity", reads=("amount",))
for _n, _x in (("main", "main_net"), ("small", "small_net"), ("net", "net_amount")):
    put(f"mf_{_n}_pct_20", "panel", 19, lambda x=_x: safe_div(ts.total(x, 20, 15), ts.total("amount", 20, 15)), category="flow", reads=(_x, "amount"))
put("mf_main_chg_20", "panel", 19, lambda: safe_div(ts.total("main_net", 5, 5), ts.total("amount", 5, 5)) - safe_div(ts.total("main_net", 20, 15), ts.total("amount", 20, 15)), category="flow", reads=("main_net", "amount"))
put("mf_smart_dumb_20", "panel", 19, lambda: safe_div(ts.total("_d", 20, 15), ts.total("amount", 20, 15)), {"_d": lambda: c("main_net") - c("small_net")}, category="flow", reads=("main_net", "small_net", "amount"))
put("turn_idio_20", "panel", 19, lambda: ts.mean("_idle", 20, 15), {"_idle": lambda: c("turnover") - F.percentile("turnover", F.lit(0.5)).over(xs.section())}, category="value", reads=("turnover",))


def _path() -> Column:
    """The shorter way from open to close through both ends of the range, a million of amount."""
    o, h, low, x = c("open"), c("high"), c("low"), c("close")
    return F.least(F.abs(h - o) + (h - low) + F.abs(x - low), F.abs(o - low) + (h - low) + F.abs(x - h)) / x / (c("amount") / 1e6)


for _n, _x in {
    "cvar_20": lambda: F.when(c("ret") < 0, c("ret")), "kpath_illiq_20": _path, "idio_illiq_20": lambda: F.abs(c("ret") - c("mkt")) / (c("amount") / 1e6),
    "semi_illiq_dn_20": lambda: F.when(c("ret") < 0, F.abs("ret") / (c("amount") / 1e6)), "semi_illiq_up_20": lambda: F.when(c("ret") > 0, F.abs("ret") / (c("amount") / 1e6)),
    "amp_downpos_20": lambda: F.when(c("high") > c("low"), (c("high") - c("close")) / (c("high") - c("low"))),
}.items():
    put(f"qz_{_n}", "panel", 19, lambda x=_x: ts.mean(x(), 20, 10), category="approximation")
put("qz_kyle_lambda_60", "panel", 59, lambda: ts.slope("ret", "_signed", 60, 0.5), {"_signed": lambda: F.signum("ret") * c("amount") / 1e6}, category="approximation")
put("qz_mf_sens_60", "panel", 59, lambda: ts.slope("ret", "_share", 60, 0.5), {"_share": lambda: c("main_net") / c("amount")}, category="approximation")
put("qz_tsim_path_20", "panel", 19, lambda: ts.corr("ret", "mkt", 20, 10) - F.abs(ts.total("_e", 20, 10)), {"_e": lambda: c("ret") - c("mkt")}, category="approximation")
put("qz_repair_eff_20", "panel", 19, lambda: F.when(ts.high("high", 20, 10) > ts.low("low", 20, 10), (c("close") - ts.low("low", 20, 10)) / (ts.high("high", 20, 10) - ts.low("low", 20, 10))), category="approximation")

_Z = {"_epz": lambda: clip(ts.zscore("ep", 60, 45), -10.0, 10.0)}
put("epd_60", "earning", 59, lambda: c("_epz"), _Z, category="value", reads=("ep",))
put("epds_60", "earning", 118, lambda: F.when(ts.std("_epz", 60, 45) > 1e-12, clip(ts.mean("_epz", 60, 45) / ts.std("_epz", 60, 45), -10.0, 10.0)), _Z, category="value", reads=("ep",))


def _before(how: str, least: int) -> Column:
    return ts.rolling("ep", 250, how, least, last=-1)


put("ep_z5", "earning", 250, lambda: F.when((_before("count", 100) >= 100) & (_before("min", 1) < _before("max", 1)), safe_div(c("ep") - _before("avg", 100), _before("stddev_samp", 100))), category="value", reads=("ep",))

# Minute features
for _n in (*mi.VALUES, "rvvol"):
    LIBRARY.register(f"hf_{_n}_20", {"day_features": ()}, category="minute", reach=Reach(19))(lambda get, n=_n: mi.factor(get["day_features"], n, 20, 15, DAY_BARS))
LIBRARY.register("hf_smartq_10", {"day_features": ()}, category="minute", reach=Reach(9))(lambda get: mi.factor(get["day_features"], "smartq", 10, 8, DAY_BARS))


@LIBRARY.frame("day_features", "minutes")
def _day_features(get):
    return mi.day_features(get["minutes"])


# Functions of frames
def use(name: str, category: str, reach: Reach, *reads: str):
    return LIBRARY.register(name, dict.fromkeys(reads, ()), category=category, reach=reach)


use("team_coin_20", "behaviour", Reach(39), "priced")(lambda get: rp.team_coin(get["priced"]))
use("climb_peak_20", "behaviour", Reach(19), "priced")(lambda get: rp.climb_peak(get["priced"]))
use("amp_nonjump_20", "behaviour", Reach(79), "priced")(lambda get: rp.jumps(get["priced"]).withColumn("value", c("amp")))
use("jump_share_20", "behaviour", Reach(79), "priced")(lambda get: rp.jumps(get["priced"]).withColumn("value", c("share")))
use("boat_follow_20", "behaviour", Reach(20), "priced")(lambda get: rp.boat_follow(get["priced"]))
use("ev_high_vol_20", "behaviour", Reach(78), "priced")(lambda get: rp.volume_events(get["priced"], True))
use("ev_low_vol_20", "behaviour", Reach(78), "priced")(lambda get: rp.volume_events(get["priced"], False))
use("chip_cost_bias", "behaviour", Reach(None), "priced")(lambda get: rp.cost_bias(get["priced"]))
use("chip_vwap_bias_250", "behaviour", Reach(249), "panel")(lambda get: rp.window_cost_bias(get["panel"].withColumn("_u", c("turnover") / 100), "_u"))
for _k, _n in ((1, "holder_num_chg"), (2, "holder_num_chg_2")):
    use(_n, "event", Reach(), "bars", "reports")(lambda get, k=_k: rp.report_change(get["bars"], get["reports"], k))
use("event_sum_20", "event", Reach(11, days=19), "bars", "actions")(lambda get: rp.event_sum(get["bars"], get["actions"], "cash", -19, 0))
use("event_ahead_60", "event", Reach(11, ahead=60), "bars", "actions")(lambda get: rp.event_sum(get["bars"], get["actions"], "cash", 0, 60))
use("lockup_pressure_60", "event", Reach(ahead=60), "bars", "actions", "capital")(lambda get: rp.per_float(get["bars"], get["capital"], get["actions"], "cash", 0, 60))
use("dragon_net_20", "event", Reach(days=20), "bars", "seats", "capital")(lambda get: rp.net_per_cap(get["bars"], get["capital"], get["seats"], "net"))
use("block_premium_20", "event", Reach(1, days=20), "bars", "blocks")(lambda get: rp.block_premium(get["bars"], get["blocks"]))
use("dividend_yield", "value", Reach(days=364), "bars", "actions")(lambda get: asof.in_windows(get["bars"], get["actions"], -364, 0, "cash", "_c").withColumn("value", c("_c") / c("close")))
for _n, _seat in (("inst", "F"), ("retail", "O")):
    use(f"{_n}_buy_20", "event", Reach(19, days=19), "bars", "seats")(lambda get, seat=_seat: asof.in_windows(get["bars"], get["seats"].where(c("seat") == seat), -19, 0, "net", "_e").withColumn("value", safe_div(c("_e") * 1e4, ts.total("amount", 20, 1))))
use("margin_report", "statement", Reach(), "bars", "reports")(lambda get: rp.report_ratio(get["bars"], get["reports"], "net_profit", "revenue"))
use("revenue_growth_yoy", "statement", Reach(), "bars", "reports")(lambda get: rp.growth(get["bars"], get["reports"], "revenue"))
use("sue", "surprise", Reach(), "bars", "reports")(lambda get: rp.surprise(get["bars"], get["reports"], "revenue"))


@LIBRARY.frame("reported", "bars", "reports")
def _reported(get):
    """Bars with profit of the latest report over a fixed number of shares."""
    p = asof.asof(get["bars"], rp.latest_reports(get["reports"]), ["net_profit"], right_on="notice")
    return p.withColumn("ep", c("net_profit") / (c("close") * 1000))


put("ep_report", "reported", 0, lambda: c("ep"), category="value")
put("ep_zscore_30", "reported", 29, lambda: ts.zscore("ep", 30, 15), category="value")
use("ep_size_dom", "value", Reach(), "reported")(lambda get: get["reported"].withColumn("half", (c("amount") >= F.percentile("amount", F.lit(0.5)).over(xs.section())).cast("int")).withColumn("value", xs.rank_pct(F.round("ep", 9), ("date", "half"))))
use("ep_momentum_product", "value", Reach(4, 4), "reported")(lambda get: get["reported"].withColumn("m", ts.change("close", 4)).where("ep is not null and m is not null").withColumn("value", xs.rank_product(F.round("ep", 9), "m")))
use("earnings_accel", "surprise", Reach(), "bars", "reports")(lambda get: rp.acceleration(get["bars"], get["reports"], "revenue"))


def _garp(get):
    g = fu.ladder(get["statements"], fu.growth("net_profit")).where("value is not null")
    p = asof.asof(get["earning"], g, ["value"], right_on="known").where("ep is not null and value is not null")
    return p.select("code", "date", xs.rank_product(F.round("ep", 9), F.round("value", 9)).alias("value"))


use("garp", "value", Reach(), "earning", "statements")(_garp)


def _newest(get, r: DataFrame) -> DataFrame:
    r = panel.latest(r.where("value is not null"), ["code", "notice"], [F.desc("period")])
    return fu.on_bars(get["bars"], r.select("code", c("notice").alias("known"), "value"))


for _n, _x in (("sue_v2", "net_profit"), ("sur", "revenue")):
    use(_n, "surprise", Reach(), "bars", "items")(lambda get, x=_x: fu.on_bars(get["bars"], panel.latest(fu.zscore_before(get["items"], x), ["code", "notice"], [F.desc("period")]).select("code", c("notice").alias("known"), "value")))


@LIBRARY.frame("profitability", "items")
def _profitability(get):
    d = fu.trailing(get["items"], ["gross_profit", "net_profit"])
    return d.withColumns({"g": safe_div(c("gross_profit_ttm"), c("total_assets")), "roe": safe_div(c("net_profit_ttm"), c("total_equity"))})


use("roe_chg", "surprise", Reach(), "bars", "profitability")(lambda get: _newest(get, fu.a_year_before(get["profitability"], ["roe"]).withColumn("value", c("roe") - c("roe_y"))))
use("sue_gpoa", "surprise", Reach(), "bars", "profitability")(lambda get: _newest(get, fu.zscore_published(get["profitability"], "g")))
use("gpoa_chg", "surprise", Reach(), "bars", "profitability")(lambda get: _newest(get, fu.change_published(get["profitability"], "g")))
use("sue_pred", "surprise", Reach(), "bars", "items", "forecasts")(lambda get: fu.on_bars(get["bars"], fu.forecast_surprise(get["items"], get["forecasts"])))


def _fused(get):
    own = fu.surprise_parameters(get["items"]).withColumn("value", clip((c("_d") - c("delta")) / c("sigma"), -10.0, 10.0))
    own = panel.latest(own, ["code", "notice"], [F.desc("period")]).select("code", c("notice").alias("known"), "value")
    return fu.decayed_events(get["bars"], own.unionByName(fu.forecast_surprise(get["items"], get["forecasts"])))


use("sue_i", "surprise", Reach(), "bars", "items", "forecasts")(_fused)

# Formulas over a dense grid, and composites that learn their weights as they go
for _n in ("pa_a101_040", "pa_a101_044", "pa_a101_088", "pa_5d_min_low_ratio"):
    use(_n, "formula", Reach(None), "bars")(lambda get, n=_n: formulas.batch(get["bars"], [n]))
COMPOSED = ("a109", "a134", "a162", "a167")


def _formula_composite(get):
    f = formulas.batch(get["bars"], list(COMPOSED)).withColumn("value", F.round("value", 6))
    return evaluate.walk_forward(f, get["bars"], 4).withColumnRenamed("score", "value")


def _minute_composite(get):
    values = {"rv": F.ln(1e4 * c("rv")), "hhi": c("v_hhi"), "hi_pos": c("hi_pos")}
    f = get["day_features"].withColumns({f"_{n}": F.round(x, 6) for n, x in values.items()})
    long = f.select("date", "code", F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), c(f"_{n}").alias("value")) for n in values])).alias("x")).select("date", "code", "x.factor", "x.value")
    return evaluate.walk_forward(long, f.select("date", "code", "close"), 1, 15, 8, 5).withColumnRenamed("score", "value")


use("a191_wf_composite", "composite", Reach(None), "bars")(_formula_composite)
use("hf_wf_composite", "composite", Reach(None), "day_features")(_minute_composite)

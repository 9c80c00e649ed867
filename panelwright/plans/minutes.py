"""Day features of minute bars, and factors that average them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.elementwise import safe_div
from panelwright.operators import ts

DAY = ("code", "date")


def _within(hours: Column, x: str = "vol") -> Column:
    return F.sum(F.when(hours, F.col(x)))


def price_path(opened: int, noon: int, closing: int) -> dict[str, Column]:
    """Where the price stood at the marks, against the first open or up to the last close, and when it was at its ends."""
    begin, end = F.min_by("open", "bar"), F.max_by("close", "bar")

    def before(hour: int) -> Column:
        return F.max_by("close", F.when(F.col("hour") < hour, F.col("bar")))

    def place(of: Column) -> Column:
        return of / F.count("*")

    return {
        "close": end, "day_range": F.max("high") - F.min("low"),
        "r_first": before(opened) / begin - 1, "r_am": before(noon) / begin - 1, "r_pm": end / before(noon) - 1, "r_last": end / before(closing) - 1,
        "hi_pos": place(F.max_by("bar", F.struct(F.col("high"), -F.col("bar")))), "lo_pos": place(F.min_by("bar", F.struct("low", "bar"))),
    }


def volume_profile(opened: int, noon: int, closing: int) -> dict[str, Column]:
    """How the day's volume is spread over the hours and over the bars."""
    whole, hour = F.sum("vol"), F.col("hour")
    return {
        "v_am": _within(hour < noon), "v_pm": _within(hour >= noon), "v_open": _within(hour < opened) / whole, "v_close": _within(hour >= closing) / whole,
        "v_top1": F.max("vol") / whole, "v_hhi": F.sum(F.pow("vol", F.lit(2))) / F.pow(whole, F.lit(2)),
    }


def variation() -> dict[str, Column]:
    """Sums of powers of the bars' log returns, on both sides, and the product of neighbours, which jumps hardly move."""
    r, square = F.col("r"), F.pow("r", F.lit(2))
    side = {f"rs_{name}": F.sum(F.when(sign, square)) for name, sign in (("neg", r < 0), ("pos", r > 0))}
    powers = {name: F.sum(F.pow("r", F.lit(k))) for name, k in (("rv", 2), ("sum_r3", 3), ("sum_r4", 4))}
    return {**side, **powers, "bv": F.sum(F.abs(r * F.col("r_before"))) * F.pi() / 2}


def liquidity() -> dict[str, Column]:
    """What a unit of volume or money goes with."""
    size = F.abs("r")
    return {"n_min": F.count("*"), "amt_sum": F.sum("amount"), "vwap": F.sum("amount") / F.sum("vol"), "abi": F.avg(size), "amihud_min": F.avg(safe_div(size, F.col("amount"))), "corr_rv": F.corr("r", "vol")}


def leading(m: DataFrame, order: Column, share: float = 0.2) -> DataFrame:
    """The minutes of m that come first by `order` (falling, then by time) until they hold `share` of the day's volume; the one that reaches it is the last."""
    w = Window.partitionBy(*DAY)
    ahead = F.coalesce(F.sum("vol").over(w.orderBy(order.desc(), "bar").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return m.withColumn("_ahead", ahead).withColumn("_whole", F.sum("vol").over(w)).where(F.col("_ahead") < share * F.col("_whole")).drop("_ahead", "_whole")


def day_features(minutes: DataFrame, marks: tuple[int, int, int] = (6, 12, 18)) -> DataFrame:
    """A row a code and day of minute bars (code, date, datetime, open, high, low, close, vol, amount).

    marks are the hours that end the opening, the first half and the time before the close. Bars without a
    price above 0 are left out; days without a traded bar that has a return have no row. Windows are over the
    minutes of one code and day.
    """
    w = Window.partitionBy(*DAY).orderBy("datetime")
    m = minutes.where("close > 0").withColumns({"bar": F.row_number().over(w), "hour": F.hour("datetime"), "r": F.ln(F.col("close") / F.lag("close").over(w))})
    m = m.withColumn("r_before", F.lag("r").over(w))
    columns = {**price_path(*marks), **volume_profile(*marks), **variation(), **liquidity()}
    day = m.groupBy(*DAY).agg(*[x.alias(name) for name, x in columns.items()])

    traded = m.where("vol > 0 and r is not null")
    # Moves that took little volume are the informed ones.
    informed = F.round(F.abs("r") / F.pow(F.greatest("vol", F.lit(1.0)), F.lit(0.25)), 9)
    smart = leading(traded, informed).groupBy(*DAY).agg((F.sum("amount") / F.sum("vol")).alias("_price"))
    busy = leading(traded, F.col("vol")).groupBy(*DAY).agg(F.sum("r").alias("topv_r"), (F.sum(F.when(F.col("r") > 0, F.col("vol")).otherwise(0.0)) / F.sum("vol")).alias("topv_upr"))
    return day.join(smart, list(DAY)).join(busy, list(DAY)).withColumn("smart_q", F.col("_price") / F.col("vwap")).drop("_price")


def _f(x: str) -> Column:
    return F.col(x)


#: What each factor averages over its rows.
VALUES = {
    "rv": lambda: F.ln(1e4 * _f("rv")), "rjv": lambda: F.greatest(_f("rv") - _f("bv"), F.lit(0.0)) / _f("rv"), "rsk": lambda: F.sqrt("n_min") * _f("sum_r3") / F.pow("rv", F.lit(1.5)), "rku": lambda: _f("n_min") * _f("sum_r4") / (_f("rv") * _f("rv")), "dsem": lambda: _f("rs_neg") / _f("rv"),
    "vopen": lambda: _f("v_open"), "vclose": lambda: _f("v_close"), "vhhi": lambda: _f("v_hhi"), "vampp": lambda: safe_div(_f("v_am"), _f("v_pm")), "rlast30": lambda: _f("r_last"), "rfirst30": lambda: _f("r_first"), "hipos": lambda: _f("hi_pos"), "amihud": lambda: F.ln(1 + _f("amihud_min")),
    "amtrange": lambda: F.ln(1 + safe_div(_f("amt_sum"), _f("day_range"))), "vwapbias": lambda: safe_div(_f("close"), _f("vwap")) - 1, "corr_rv": lambda: _f("corr_rv"), "smartq": lambda: _f("smart_q"), "topvr": lambda: _f("topv_r"), "topvupr": lambda: _f("topv_upr"),
}


def factor(features: DataFrame, name: str, window: int = 20, least: int = 15, minutes: int = 120) -> DataFrame:
    """code, date, value: the mean of VALUES[name] over `window` rows of days with at least `minutes` bars and some variance; rvvol: the deviation of rv over its mean."""
    d = features.where((F.col("n_min") >= minutes) & (F.col("rv") > 0)).withColumn("_x", VALUES["rv" if name == "rvvol" else name]())
    mean = ts.mean("_x", window, least)
    return d.select("code", "date", (safe_div(ts.std("_x", window, least), mean) if name == "rvvol" else mean).alias("value"))

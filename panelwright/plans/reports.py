"""Factors from behaviour, events and published reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.elementwise import clip, safe_div
from panelwright.operators import asof, panel, ts, xs
from panelwright.plans import fundamentals


def team_coin(p: DataFrame, d: int = 20) -> DataFrame:
    """Mean of three d-row return sums, each turned round where its volatility is not below the one of the rows before."""
    out = None
    for r in ("ret", "overnight", "intraday"):
        p = p.withColumns({f"_s_{r}": ts.total(r, d), f"_v_{r}": ts.std(r, d), f"_w_{r}": ts.rolling(r, d, "stddev_samp", d, last=-d)})
        one = F.when(F.col(f"_v_{r}") >= F.col(f"_w_{r}"), -F.col(f"_s_{r}")).otherwise(F.col(f"_s_{r}"))
        out = one if out is None else out + one
    return p.withColumn("value", out / 3)


def climb_peak(p: DataFrame, d: int = 20) -> DataFrame:
    """Covariance of return and range variance over rows whose variance is at least mean + deviation of the window; three at least."""
    p = p.withColumn("_x", F.pow(F.ln(F.col("high") / F.col("low")), F.lit(2)) / (4 * F.log(F.lit(2.0))))
    # The bound belongs to the current row, so the window's rows are compared with it as a list.
    rows = F.collect_list(F.when(F.col("ret").isNotNull(), F.struct(F.col("ret").alias("r"), F.col("_x").alias("x")))).over(ts.rows(1 - d))
    p = p.withColumns({"_l": rows, "_b": F.avg("_x").over(ts.rows(1 - d)) + F.stddev_samp("_x").over(ts.rows(1 - d))})
    p = p.withColumn("_l", F.filter("_l", lambda e: e["x"] >= F.col("_b")))
    n = F.size("_l")
    total = lambda f: F.aggregate("_l", F.lit(0.0), lambda a, e: a + f(e))
    cov = (total(lambda e: e["r"] * e["x"]) - total(lambda e: e["r"]) * total(lambda e: e["x"]) / n) / (n - 1)
    return p.withColumn("value", F.when(n >= 3, cov))


def jumps(p: DataFrame, d: int = 20, before: int = 60, least: int = 20) -> DataFrame:
    """amp: mean range of rows without a jump; share: that of jumps. A jump is a gap beyond two deviations of the rows before."""
    p = p.withColumn("_sd", ts.rolling("overnight", before, "stddev_samp", least, last=-1))
    p = p.withColumn("_j", F.when(F.col("_sd").isNotNull(), (F.abs("overnight") > 2 * F.col("_sd")).cast("double")))
    amp = (F.col("high") - F.col("low")) / F.col("close")
    return p.withColumns({"amp": ts.mean(F.when(F.col("_j") == 0, amp), d, 5), "share": ts.mean("_j", d, 10)})


def boat_follow(p: DataFrame, d: int = 20) -> DataFrame:
    """Population covariance of the code's and the market's change in ln amount over their sample deviations."""
    p = p.withColumn("_a", F.ln("amount") - F.ln(ts.delay("amount")))
    p = p.withColumn("_m", F.avg("_a").over(xs.section()))
    w = ts.rows(1 - d)
    both = F.col("_a").isNotNull()
    return p.withColumn("value", F.when(F.count("_a").over(w) >= 15, safe_div(F.covar_pop("_a", F.when(both, F.col("_m"))).over(w), F.stddev_samp("_a").over(w) * F.stddev_samp(F.when(both, F.col("_m"))).over(w))))


def volume_events(p: DataFrame, high: bool, d: int = 20, look: int = 60, least: int = 45) -> DataFrame:
    """How often in d rows volume stood in its top fifth with the close in its top (or bottom) fifth."""
    p = p.withColumns({"_v": ts.quantile("vol", look, 0.8, least), "_c": ts.quantile("close", look, 0.8 if high else 0.2, least)})
    near = F.col("close") >= F.col("_c") if high else F.col("close") <= F.col("_c")
    flag = F.when(F.col("_v").isNotNull(), ((F.col("vol") >= F.col("_v")) & near).cast("int"))
    return p.withColumn("value", ts.total(flag, d, 10))


def cost_bias(p: DataFrame, unit: float = 2000.0) -> DataFrame:
    """Close over the turnover-decayed mean cost, less 1."""
    p = p.withColumn("_u", F.col("vol") / unit)
    return ts.held_cost(p, "close", "_u", "_cost", block=60).withColumn("value", safe_div(F.col("close"), F.col("_cost")) - 1)


def window_cost_bias(p: DataFrame, turnover: str, rows: int = 250) -> DataFrame:
    """Close over the turnover-decayed mean cost of the last `rows` rows, less 1: the cost begins with the first close of the window, and each row takes its share of turnover (1 at most) at its close."""
    row = F.struct(F.col("close").alias("p"), F.least(F.col(turnover), F.lit(1.0)).alias("u"))
    held = F.collect_list(F.when(F.col("close").isNotNull() & F.col(turnover).isNotNull(), row)).over(ts.rows(1 - rows))
    cost = F.aggregate("_h", F.col("_h")[0]["p"], lambda a, x: a * (1 - x["u"]) + x["p"] * x["u"])
    p = p.withColumn("_h", held).withColumn("value", F.when(F.size("_h") > 0, safe_div(F.col("close"), cost) - 1))
    return p.drop("_h")


def latest_reports(reports: DataFrame) -> DataFrame:
    """One row a publication date: its latest period."""
    return panel.latest(reports, ["code", "notice"], [F.desc("period")])


def report_change(p: DataFrame, reports: DataFrame, back: int = 1, days: int = 180) -> DataFrame:
    """Revenue of the latest published report over that of the `back`-th latest earlier period that was published by then, less 1, for `days` days."""
    r = reports.withColumn("q", F.year("period") * 4 + F.quarter("period"))
    r = fundamentals.published_before(r, "revenue", back).withColumn("_b", F.try_element_at("_before", F.lit(back))["v"])
    r = latest_reports(r.withColumn("value", safe_div(F.col("revenue"), F.col("_b")) - 1))
    return asof.asof(p, r, ["value"], right_on="notice", within_days=days)


def report_ratio(p: DataFrame, reports: DataFrame, top: str, below: str) -> DataFrame:
    r = latest_reports(reports.withColumn("value", safe_div(F.col(top), F.col(below))))
    return asof.asof(p, r, ["value"], right_on="notice")


def growth(p: DataFrame, reports: DataFrame, item: str) -> DataFrame:
    """Against the same period a year before."""
    before = reports.select("code", F.last_day(F.add_months("period", 12)).alias("period"), F.col(item).alias("_y"))
    r = reports.join(before, ["code", "period"]).withColumn("value", safe_div(F.col(item) - F.col("_y"), F.abs("_y")))
    return asof.asof(p, latest_reports(r), ["value"], right_on="notice")


def acceleration(p: DataFrame, reports: DataFrame, item: str) -> DataFrame:
    """Change of the growth over a year from one quarter to the next, within 5; null where the quarter before has none."""
    q = (F.year("period") * 4 + F.quarter("period")).cast("int")
    r = reports.withColumn("q", q)
    r = r.join(r.select("code", (F.col("q") + 4).alias("q"), F.col(item).alias("_y")), ["code", "q"])
    r = r.withColumn("_g", safe_div(F.col(item) - F.col("_y"), F.abs("_y")))
    w = Window.partitionBy("code").orderBy("q")
    r = r.withColumn("value", F.when(F.lag("q").over(w) == F.col("q") - 1, clip(F.col("_g") - F.lag("_g").over(w), -5.0, 5.0))).where("value is not null")
    return asof.asof(p, latest_reports(r), ["value"], right_on="notice")


def surprise(p: DataFrame, reports: DataFrame, item: str = "net_profit", n: int = 8, least: int = 4) -> DataFrame:
    """Change over a year less the mean of those of the n quarters before, over the deviation of the n errors before; known once all that it is made of is published."""
    q = (F.year("period") * 4 + F.quarter("period")).cast("int")
    before = reports.select("code", (q + 4).alias("_q"), F.col(item).alias("_y"), F.col("notice").alias("_n"))
    r = reports.withColumn("_q", q).join(before, ["code", "_q"]).withColumn("_d", F.col(item) - F.col("_y"))
    along = Window.partitionBy("code").orderBy("_q")
    w, reach = along.rangeBetween(-n, -1), along.rangeBetween(-2 * n, -1)
    r = r.withColumns({"_m": F.avg("_d").over(w), "_c": F.count("_d").over(w), "_k": F.greatest("notice", "_n", F.max(F.greatest("notice", "_n")).over(reach))})
    r = r.withColumn("_e", F.when(F.col("_c") >= least, F.col("_d") - F.col("_m"))).where("_e is not null")
    r = r.withColumn("_s", F.when(F.count("_e").over(w) >= least, F.stddev_samp("_e").over(w)))
    r = r.withColumn("value", clip(safe_div(F.col("_e"), F.col("_s")), -10.0, 10.0)).where("value is not null")
    r = panel.latest(r.select("code", "period", F.col("_k").alias("known"), "value"), ["code", "known"], [F.desc("period")])
    return asof.asof(p, r, ["value"], right_on="known")


def per_float(p: DataFrame, capital: DataFrame, events: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Sum of an event's value from `first` to `last` days around each bar, over the float of its date; 0 without an event."""
    d = asof.asof(asof.in_windows(p, events, first, last, value, "_e"), capital, ["float_shares"])
    return d.withColumn("value", safe_div(F.col("_e"), F.col("float_shares")))


def net_per_cap(p: DataFrame, capital: DataFrame, events: DataFrame, value: str, days: int = 20) -> DataFrame:
    """Sum of an event's value over the last `days` calendar days, over the market value of the float, as it can be traded on: events count from the day after theirs."""
    d = asof.asof(asof.in_windows(p, events, -days, -1, value, "_e"), capital, ["float_shares"])
    return d.withColumn("value", safe_div(F.col("_e"), F.col("float_shares") * F.col("close")))


def block_premium(p: DataFrame, blocks: DataFrame, days: int = 20) -> DataFrame:
    """Premium of block trades over the close known when they were made, weighted by amount over the last `days` calendar days, from the day after each; 0 without a trade."""
    b = asof.asof(blocks, p.select("code", "date", "close"), ["close"], strict=True).where("close > 0")
    b = b.withColumn("_w", F.col("amount") * (F.col("price") / F.col("close") - 1))
    d = asof.in_windows(asof.in_windows(p, b, -days, -1, "_w", "_p"), b, -days, -1, "amount", "_a")
    return d.withColumn("value", F.coalesce(safe_div(F.col("_p"), F.col("_a")), F.lit(0.0)))


def event_sum(p: DataFrame, events: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Sum of an event's value from `first` to `last` days around each bar, over the mean amount of 12 rows."""
    d = asof.in_windows(p, events, first, last, value, "_e")
    return d.withColumn("value", safe_div(F.col("_e"), ts.mean("amount", 12, 1)))

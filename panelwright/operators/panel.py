"""Building and filtering panels keyed by (date, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.elementwise import safe_div
from panelwright.operators import ts


def adjusted(bars: DataFrame, factor: str = "adj_factor") -> DataFrame:
    """Prices times the adjustment factor, and vwap; volume and amount stay."""
    a = F.col(factor)
    return bars.withColumns({**{c: F.col(c) * a for c in ("open", "high", "low", "close")}, "vwap": safe_div(F.col("amount"), F.col("vol")) * a})


def valid(bars: DataFrame) -> DataFrame:
    return bars.where((F.col("close") > 0) & (F.col("vol") > 0))


def dense(panel: DataFrame, clipped: bool = False) -> DataFrame:
    """A row for every date and code; clipped: only between a code's first and last date.

    Each code is given the market's dates by exploding one sorted list of them. The list has an entry a
    date and is broadcast with its one row; codes stay where they are.
    """
    dates = panel.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_dates"))
    codes = panel.groupBy("code").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    grid = codes.join(F.broadcast(dates)).select("code", "_a", "_b", F.explode("_dates").alias("date"))
    if clipped:
        grid = grid.where(F.col("date").between(F.col("_a"), F.col("_b")))
    return grid.select("code", "date").join(panel, ["code", "date"], "left")


def members_only(panel: DataFrame, members: DataFrame, dated: bool = False) -> DataFrame:
    return panel.join(members, ["code", "date"] if dated else ["code"], "left_semi")


def forward_return(close: str = "close", h: int = 1) -> Column:
    """close h rows later over close, less 1; null without either or where close is not above 0."""
    return F.when(F.col(close) > 0, ts.lead(close, h) / F.col(close) - 1)


def forward_returns(panel: DataFrame, horizons: tuple[int, ...], close: str = "close") -> DataFrame:
    return panel.withColumns({f"fwd_{h}": forward_return(close, h) for h in horizons})


def returns(panel: DataFrame) -> DataFrame:
    """ret (close on close), overnight (open on the previous close), intraday (close on open)."""
    before = ts.delay("close")
    return panel.withColumns({"ret": safe_div(F.col("close"), before) - 1, "overnight": safe_div(F.col("open"), before) - 1, "intraday": safe_div(F.col("close"), F.col("open")) - 1})


def unlocked(x: Column) -> Column:
    """x where the bar traded at more than one price, else null."""
    return F.when(F.col("high") > F.col("low"), x)


def executable_return(k: int, limit: float = 0.07) -> Column:
    """From the next open to the close k rows later; null if the next bar is one-price and up by `limit`."""
    o, c = ts.lead("open", 1), ts.lead("close", k)
    sealed = (ts.lead("high", 1) == ts.lead("low", 1)) & (ts.lead("close", 1) / F.col("close") - 1 >= limit)
    return F.when(~F.coalesce(sealed, F.lit(False)) & (o > 0), c / o - 1)


def calendar(panel: DataFrame) -> DataFrame:
    """trade_date, its number from 1, the previous and the next one, year, month, week, over distinct dates."""
    w = Window.orderBy("trade_date")
    d = panel.select(F.col("date").alias("trade_date")).distinct()
    return d.select("trade_date", F.row_number().over(w).alias("n"), F.lag("trade_date").over(w).alias("previous"), F.lead("trade_date").over(w).alias("next"), F.year("trade_date").alias("year"), F.month("trade_date").alias("month"), F.weekofyear("trade_date").alias("week"))


def top_per_date(panel: DataFrame, score: str, n: int, by: str = "date") -> DataFrame:
    """The n highest scores of each date, ties by code."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "code")
    return panel.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def every_kth(dates: DataFrame, k: int, phase: int = 0, on: str = "date") -> DataFrame:
    """Every k-th distinct date, starting `phase` dates later."""
    w = Window.orderBy(on)
    return dates.select(on).distinct().withColumn("_i", F.row_number().over(w) - 1 - phase).where((F.col("_i") >= 0) & (F.col("_i") % k == 0)).drop("_i")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in `order`."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")

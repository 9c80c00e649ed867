"""Time-series operators: columns over windows of one code in date order.

`d` is the number of rows of a window that ends at the current row, `least` how many of them must hold a
value (all, unless given). Rows are those of the table: put the panel on a dense grid first where missing
dates should count.
"""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.elementwise import finite, safe_div

BY, ORDER = ("code",), ("date",)
#: Where windows are put that are asked for inside asking(): {(how, rows, last row, their columns as text): (name, columns)}.
_ASKED: contextvars.ContextVar[dict | None] = contextvars.ContextVar("asked", default=None)


@contextlib.contextmanager
def asking():
    """Columns made inside name the windows that they need instead of holding them: plans.along works those out for many rows at once."""
    asked: dict = {}
    token = _ASKED.set(asked)
    try:
        yield asked
    finally:
        _ASKED.reset(token)


def _window(how: str, d: int, last: int, *x: Column, **k) -> Column:
    """An aggregate of rows last-(d-1)..last, or the value `last` rows away (lag)."""
    asked = _ASKED.get()
    if asked is not None and not k and last <= 0:
        key = (how, d, last, *map(str, x))
        return F.col(asked.setdefault(key, (f"_w{len(asked)}_", x))[0])
    if how == "lag":
        return F.lag(x[0], -last).over(along(**k))
    return getattr(F, how)(*x).over(rows(last - d + 1, last, **k))


def rows(first: int | None, last: int = 0, by=BY, order=ORDER) -> WindowSpec:
    """Rows first..last around the current one; first None: from the code's first row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding if first is None else first, last)


def along(by=BY, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _full(x: Column, value: Column, w: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(w) >= least, value)


def _enough(x: Column, value: Column, d: int, least: int, last: int = 0, **k) -> Column:
    return F.when(_window("count", d, last, x, **k) >= least, value)


def delay(x, d: int = 1, **k) -> Column:
    return _window("lag", 1, -d, _col(x), **k)


def lead(x, d: int = 1, **k) -> Column:
    return F.lead(_col(x), d).over(along(**k))


def delta(x, d: int = 1, **k) -> Column:
    return _col(x) - delay(x, d, **k)


def change(x, d: int = 1, **k) -> Column:
    """x / x[t-d] - 1, null where that was 0."""
    return safe_div(_col(x), delay(x, d, **k)) - 1


def rolling(x, d: int, how: str, least: int | None = None, last: int = 0, **k) -> Column:
    """One of avg, sum, min, max, stddev_samp, stddev_pop, count over rows last-(d-1)..last."""
    x = _col(x)
    value = _window(how, d, last, x, **k)
    return value if how == "count" else _enough(x, value, d, d if least is None else least, last, **k)


def mean(x, d, least=None, **k) -> Column:
    return rolling(x, d, "avg", least, **k)


def total(x, d, least=None, **k) -> Column:
    return rolling(x, d, "sum", least, **k)


def std(x, d, least=None, **k) -> Column:
    return rolling(x, d, "stddev_samp", least, **k)


def low(x, d, least=None, **k) -> Column:
    return rolling(x, d, "min", least, **k)


def high(x, d, least=None, **k) -> Column:
    return rolling(x, d, "max", least, **k)


def rank(x, d: int, least: int | None = None, **k) -> Column:
    """Average rank of the current value among its window's, divided by their number."""
    x = _col(x)
    w = rows(1 - d, 0, **k)
    all_ = F.collect_list(x).over(w)
    below = F.size(F.filter(all_, lambda v: v < x))
    same = F.size(F.filter(all_, lambda v: v == x))
    return F.when(x.isNotNull(), _full(x, (below + (same + 1) / 2) / F.size(all_), w, d if least is None else least))


def corr(x, y, d: int, least: int | None = None, **k) -> Column:
    """Pearson correlation over rows where both have values; null where either does not vary."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    of = lambda how, *c: _window(how, d, 0, *c, **k)
    # Equal values in a window leave rounding dust in the deviations, so variation is judged by the extremes.
    varies = (of("min", x) < of("max", x)) & (of("min", y) < of("max", y))
    return F.when(varies, _enough(x, finite(of("corr", x, y)), d, d if least is None else least, **k))


def cov(x, y, d: int, least: int | None = None, **k) -> Column:
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    w = rows(1 - d, 0, **k)
    return _full(F.when(both, x), F.covar_samp(F.when(both, x), F.when(both, y)).over(w), w, d if least is None else least)


def argmax(x, d: int, sign: int = 1, least: int | None = None, **k) -> Column:
    """Position of the first greatest value, counted from the window's first row; nulls are passed over."""
    x = _col(x)
    w = rows(1 - d, 0, **k)
    all_ = F.collect_list(F.coalesce(x * sign, F.lit(float("-inf")))).over(w)
    return F.when(F.size(all_) == d, _full(x, (F.array_position(all_, F.array_max(all_)) - 1).cast("int"), w, 1 if least is None else least))


def argmin(x, d: int, **k) -> Column:
    return argmax(x, d, sign=-1, **k)


def decay_linear(x, n: int, **k) -> Column:
    """Weights 1..n, the newest heaviest; null if any value is."""
    out = _col(x) * n
    for i in range(1, n):
        out = out + delay(x, i, **k) * (n - i)
    return out / (n * (n + 1) / 2)


def slope(y, x, d: int, share: float = 0.7, **k) -> Column:
    """Least-squares slope of y on x over pairs, of which there must be share * d."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    s = lambda c: _window("sum", d, 0, c, **k)
    n = _window("count", d, 0, x, **k)
    below = n * s(x * x) - s(x) * s(x)
    return F.when((n >= share * d) & (F.abs(below) > 1e-12), (n * s(x * y) - s(x) * s(y)) / below)


def zscore(x, d: int, least: int, **k) -> Column:
    """(x - mean) / std of its window; null where it does not vary."""
    x = _col(x)
    of = lambda how: _window(how, d, 0, x, **k)
    return F.when(of("min") < of("max"), _enough(x, safe_div(x - of("avg"), of("stddev_samp")), d, least, **k))


def percentile_of(x, d: int, least: int, **k) -> Column:
    """Share of the window's values that are at most the current one."""
    x = _col(x)
    w = rows(1 - d, 0, **k)
    all_ = F.collect_list(x).over(w)
    return F.when(x.isNotNull(), _full(x, F.size(F.filter(all_, lambda v: v <= x)) / F.size(all_), w, least))


def quantile(x, d: int, q: float, least: int, **k) -> Column:
    x = _col(x)
    w = rows(1 - d, 0, **k)
    return _full(x, F.percentile(x, F.lit(q)).over(w), w, least)


def last_known(x, **k) -> Column:
    return F.last(_col(x), ignorenulls=True).over(rows(None, **k))


def drawdown(x, **k) -> Column:
    return _col(x) / F.max(_col(x)).over(rows(None, **k)) - 1


def log_growth(r) -> Column:
    """ln(1 + r): minus infinity at -1 and NaN below, as in SQL, where log1p gives null and a sum would pass over it."""
    r = _col(r)
    return F.when(r < -1, float("nan")).when(r == -1, float("-inf")).otherwise(F.log1p(r))


def compounded(r, **k) -> Column:
    """Product of 1 + r up to the row; 0 from an r of -1 on, NaN from one below."""
    return F.exp(F.sum(log_growth(r)).over(rows(None, **k)))


def survival(turnover, **k) -> Column:
    """Share of holdings never traded since the first row: the product of 1 - turnover."""
    return compounded(-_col(turnover), **k)


def held_cost(df: DataFrame, price: str, turnover: str, out: str, block: int = 120, by: str = "code", order: str = "date") -> DataFrame:
    """Turnover-decayed mean cost c_t = c_{t-1} (1 - u_t) + p_t u_t, from the first row's price.

    With S_t the product of 1 - u, c_t / S_t is a running sum of p u / S. S falls towards 0, so rows are
    cut into blocks of `block` rows; a block's cost on its own and its survival are found by windows, and
    the costs handed from block to block by a fold over the code's blocks (one struct a block).
    """
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / block))
    inside = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    u = F.when(F.col("_i") == 0, F.lit(1.0 - 1e-12)).otherwise(F.least(F.coalesce(F.col(turnover), F.lit(0.0)), F.lit(1.0 - 1e-12)))
    d = d.withColumn("_s", F.exp(F.sum(F.log1p(-u)).over(inside)))
    d = d.withColumn("_own", F.col("_s") * F.sum(F.coalesce(F.col(price), F.lit(0.0)) * u / F.col("_s")).over(inside))
    blocks = d.groupBy(by, "_b").agg(F.max_by("_s", "_i").alias("s"), F.max_by("_own", "_i").alias("c"))
    listed = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.aggregate(F.collect_list(F.struct("s", "c")).over(listed), F.lit(0.0), lambda a, x: a * x["s"] + x["c"])
    blocks = blocks.select(by, "_b", carried.alias("_before"))
    return d.join(blocks, [by, "_b"]).withColumn(out, F.col("_before") * F.col("_s") + F.col("_own")).drop("_i", "_b", "_s", "_own", "_before")


def runs(df: DataFrame, sign: Column, by: str = "code", order: str = "date") -> DataFrame:
    """Rows with run (number of the stretch of equal signs) and run_length."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_s", sign)
    d = d.withColumn("_new", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("run_length", F.count("*").over(Window.partitionBy(by, "run"))).drop("_s", "_new")


def cooled_down(df: DataFrame, flag: str, k: int, by: str = "code", order: str = "date") -> DataFrame:
    """df with kept (boolean): events that come more than k rows after the last kept one of their code.

    Whether an event is kept depends on those kept before, so each code's events are folded in order: one
    list of row numbers a code, events only.
    """
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_i", F.row_number().over(w).cast("long"))
    start = F.array().cast("array<long>")
    step = lambda a, i: F.when((F.size(a) == 0) | (i - F.element_at(a, -1) > k), F.concat(a, F.array(i))).otherwise(a)
    kept = d.where(F.col(flag)).groupBy(by).agg(F.array_sort(F.collect_list("_i")).alias("_e")).select(by, F.explode(F.aggregate("_e", start, step)).alias("_i"), F.lit(True).alias("kept"))
    return d.join(kept, [by, "_i"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("_i")

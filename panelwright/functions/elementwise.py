"""Element-wise functions. Nulls propagate unless said otherwise; nothing returns NaN or an infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return finite(F.try_divide(a, b))


def guarded_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def guarded_pow(x: Column, p: float) -> Column:
    return F.when(x >= 0, finite(F.pow(x, F.lit(p))))


def if_else(cond: Column, a: Column, b: Column) -> Column:
    """a where cond holds, else b; a null condition counts as false."""
    return F.when(cond, a).otherwise(b)


def pair_max(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def pair_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))

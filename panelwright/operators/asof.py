"""As-of joins: the latest known right-hand row for each left-hand row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, columns: list[str], by: str = "code", left_on: str = "date", right_on: str = "date", within_days: int | None = None, strict: bool = False) -> DataFrame:
    """left with `columns` of the latest right row of the same key whose time is at or before (strict: before) the left's.

    Both sides are put in one table by key and time and the last right row is carried forward, so there is
    one shuffle whatever the sizes and no range join. Ties on the right's time keep the greatest values.
    within_days drops values older than that. A key that holds very many rows is still one window; give a
    finer key if one is expected.
    """
    value, row = F.struct(*[F.col(c) for c in columns]), F.struct("*")
    r = right.where(F.col(right_on).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(right_on).alias("_t")).agg(F.max(value).alias("_v"))
    r = r.select("_k", "_t", F.lit(1 if strict else 0).alias("_o"), F.struct("_t", "_v").alias("_v"))
    lft = left.select(F.col(by).alias("_k"), F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_o"), row.alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = _union(r, lft).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    fresh = F.lit(True) if within_days is None else F.datediff(F.col("_t"), F.col("_v._t")) <= within_days
    return filled.select("_row.*", *[F.when(fresh, F.col(f"_v._v.{c}")).alias(c) for c in columns])


def asof_each(left: DataFrame, right: DataFrame, columns: list[str], by: str = "code", left_on: str = "date", right_on: str = "date") -> DataFrame:
    """As asof(), but each column by itself keeps its last value that is not null: one join for as many ladders as there are columns."""
    r = right.where(F.col(right_on).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(right_on).alias("_t")).agg(F.struct(*[F.max(c).alias(c) for c in columns]).alias("_v"))
    lft = left.select(F.col(by).alias("_k"), F.col(left_on).alias("_t"), F.lit(1).alias("_o"), F.struct("*").alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = _union(r.withColumn("_o", F.lit(0)), lft)
    filled = both.withColumns({f"_v{i}": F.last(F.col("_v")[c], ignorenulls=True).over(w) for i, c in enumerate(columns)}).where(F.col("_row").isNotNull())
    return filled.select("_row.*", *[F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)])


def _union(r: DataFrame, left: DataFrame) -> DataFrame:
    r = r.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType))
    left = left.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType))
    return r.unionByName(left)


def validity(ladder: DataFrame, by: str = "code", on: str = "date", until: str = "until") -> DataFrame:
    """The ladder with the time at which the next row of its key takes over (null: never)."""
    return ladder.withColumn(until, F.lead(on).over(Window.partitionBy(by).orderBy(on)))


def in_windows(bars: DataFrame, events: DataFrame, first: int, last: int, value: str, out: str, by: str = "code", on: str = "date") -> DataFrame:
    """bars with the sum of `value` over events from `first` to `last` days around the bar; 0 without events.

    Bars and each key's events are merged into one ordered table and summed over a range frame in days, so
    an event is never copied to the bars that it reaches.
    """
    e = events.groupBy(by, on).agg(F.sum(value).alias("_v")).withColumn("_bar", F.lit(False))
    b = bars.select(by, on).distinct().withColumn("_v", F.lit(None).cast("double")).withColumn("_bar", F.lit(True))
    both = e.select(by, on, "_v", "_bar").unionByName(b.select(by, on, "_v", "_bar")).withColumn("_d", F.datediff(F.col(on), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(by).orderBy("_d").rangeBetween(first, last)
    sums = both.withColumn("_s", F.sum("_v").over(w)).where("_bar").select(by, on, F.coalesce("_s", F.lit(0.0)).alias(out))
    return bars.join(sums, [by, on], "left")

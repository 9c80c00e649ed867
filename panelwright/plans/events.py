"""Books of events: paths after an event, cut at a stop, and what the open ones return each date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import ts


def paths(bars: DataFrame, event: Column, hold: int, stop: float | None = None) -> DataFrame:
    """A row a row held: code, opened (the event's date), k (1 for the row after it), date, ret, last and stopped.

    bars has code, date and ret; an event is held for `hold` rows from the next one on. With `stop`, the first
    row on which what it has compounded to is at or below 1 - stop is its last. last marks the row on which an
    event is closed; one that the table's end cuts off has none. A null return counts as 0.
    """
    row = F.struct("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    ahead = F.collect_list(row).over(ts.rows(1, hold))  # bounded by `hold`
    d = bars.withColumns({"_event": event, "_path": ahead}).where("_event").select("code", F.col("date").alias("opened"), "_path")
    upto = F.transform("_path", lambda x, i: F.aggregate(F.slice("_path", 1, i + 1), F.lit(1.0), lambda a, r: a * (1 + r["ret"])))
    breach = F.lit(0) if stop is None else F.array_position(F.transform(upto, lambda v: v <= 1 - stop), True)
    d = d.withColumn("_breach", breach.cast("int"))
    d = d.withColumn("_path", F.when(F.col("_breach") > 0, F.slice("_path", 1, F.greatest(F.col("_breach"), F.lit(1)))).otherwise(F.col("_path")))
    d = d.select("code", "opened", "_breach", F.posexplode("_path").alias("k", "x")).withColumn("k", F.col("k") + 1)
    stopped = (F.col("_breach") > 0) & (F.col("k") == F.col("_breach"))
    return d.select("code", "opened", "k", "x.date", "x.ret", (stopped | (F.col("k") == hold)).alias("last"), stopped.alias("stopped"))


def book(held: DataFrame, cost_in: float = 0.0, cost_out: float = 0.0) -> DataFrame:
    """A row a date of paths(): n open events, ret (their mean return), entries and exits (shares of the open ones), stops, and net, ret less each share's cost."""
    share = lambda c: F.avg(c.cast("double"))
    d = held.groupBy("date").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), share(F.col("k") == 1).alias("entries"), share(F.col("last")).alias("exits"), F.count(F.when(F.col("stopped"), 1)).alias("stops"))
    return d.withColumn("net", F.col("ret") - F.col("entries") * cost_in - F.col("exits") * cost_out)

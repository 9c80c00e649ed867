"""States of entities from a log of changes: gap-free intervals, and the state on each date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import asof
from panelwright.operators.panel import latest


def state_of(name: Column, rules: list[tuple[str, int]], otherwise: int = 0) -> Column:
    """The state of the first rule (a regular expression, a state) that the name matches."""
    out = F.lit(otherwise)
    for pattern, state in reversed(rules):
        out = F.when(F.coalesce(name.rlike(pattern), F.lit(False)), state).otherwise(out)
    return out


def intervals(log: DataFrame, rules: list[tuple[str, int]], otherwise: int = 0) -> DataFrame:
    """code, start, until, state: from `start` to before `until` (null: still) the state holds.

    log has code, name, start (the date from which the name stands) and announced. A name stands until the
    next one starts, whatever lies between, so there are no gaps. Of several names of one start the one
    announced last stands (ties: the greatest name); names that follow each other in one state are one interval.
    """
    d = latest(log.where(F.col("start").isNotNull()), ["code", "start"], [F.desc_nulls_last("announced"), F.desc("name")])
    w = Window.partitionBy("code").orderBy("start")
    d = d.withColumn("state", state_of(F.col("name"), rules, otherwise))
    d = d.withColumn("_was", F.lag("state").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("state")))
    return d.select("code", "start", F.lead("start").over(w).alias("until"), "state")


def on_dates(panel: DataFrame, log: DataFrame, rules: list[tuple[str, int]], otherwise: int = 0) -> DataFrame:
    """panel (code, date) with the state of each date; `otherwise` before a code's first name, and where it has none."""
    d = asof.asof(panel, intervals(log, rules, otherwise), ["state"], right_on="start")
    return d.withColumn("state", F.coalesce("state", F.lit(otherwise)))

"""Do factors know the future? All of them recomputed as of several dates from one set of tables.

Each cut date has a copy of the tables as they stood then. A copy's codes carry its number, and its dates are
moved by whole cycles of the calendar (400 years, after which days of the week, months and leap years repeat), so
that windows along codes and sections of dates keep to their copy, and factors need not know that they are replayed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.plans.registry import Registry

#: Days after which the Gregorian calendar repeats.
CYCLE = 146_097
#: Copies that end before the year 10000.
MOST_CUTS = 18
#: What later values are turned into, as x * SCRAMBLE[0] + SCRAMBLE[1].
SCRAMBLE = (2.718282, 1.414214)


def _upto(registry: Registry, name: str, cut: dt.date) -> Column:
    """Whether a row of the table was known on the evening of that date: prices are, events that come out after the close aren't, announced ones are in advance."""
    t = registry.tables[name]
    if t.date is None:
        return F.lit(True)
    day = F.lit(cut).cast("date")
    return F.col(t.date) < day if t.late else F.col(t.date) <= F.date_add(day, t.announced)


def copies(registry: Registry, names: list[str], tables: Mapping[str, DataFrame], cuts: list[dt.date], scramble: bool = False, since: list[dt.date | None] | None = None) -> dict[str, DataFrame]:
    """The tables that the named factors read, once as they are (copy 0) and once for each cut: without what was not known by then, or with those rows' numbers scrambled.

    since: for each cut the first date that its copy needs of tables that count by rows; copy 0 keeps the earliest.
    """
    out = {}
    for name in {s for n in names for s in registry.sources(n)}:
        t, df = registry.tables[name], tables[name]
        known = [_upto(registry, name, cut) for cut in cuts]
        keep = [F.lit(True) if scramble else k for k in known]
        if since and None not in since and t.rule == "rows" and t.date is not None:
            keep = [k & (F.col(t.date) >= F.lit(s).cast("date")) for k, s in zip(keep, since, strict=True)]
            df = df.where(F.col(t.date) >= F.lit(min(since)).cast("date"))
        which = F.array_compact(F.array(F.lit(0), *[F.when(k, F.lit(i + 1)) for i, k in enumerate(keep)]))
        df = df.withColumn("_copy", F.explode(which))
        if scramble:
            later = F.lit(False)
            for i, k in enumerate(known):
                later = later | ((F.col("_copy") == i + 1) & ~k)
            numbers = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
            df = df.withColumns({c: F.when(later, F.col(c) * SCRAMBLE[0] + SCRAMBLE[1]).otherwise(F.col(c)) for c in numbers})
        dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        df = df.withColumns({"code": F.concat("code", F.lit("@"), F.col("_copy")), **{c: F.date_add(c, F.col("_copy") * CYCLE) for c in dates}})
        out[name] = df.drop("_copy")
    return out


def replay(registry: Registry, names: list[str], tables: Mapping[str, DataFrame], cuts: list[dt.date], scramble: bool = False, look: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """factor, cut, n, different, worst: the values that the named factors have on each cut date, computed from all rows and from what was known then.

    n counts the (code, date) compared, different those whose values are further apart than `tolerance` (of
    the larger one, where that is above 1) or stand in one of the two alone, worst is the largest distance
    of two values. With scramble=True later rows stay, with other numbers, and all dates up to a cut are
    compared, those of the last `look` days where that is given: history must not move.

    There is one copy of the input a cut. Where a factor needs only some rows and one section is compared, a copy holds
    those rows alone; factors that need all rows come after the others. Some factors are compared at a time
    (Registry.each), and the copies go with the last of them; the few rows of the result are a stored table.
    Tables that many factors read are best stored first (Registry.kept).
    """
    if len(cuts) > MOST_CUTS or len(set(cuts)) < len(cuts):
        raise ValueError(f"replay takes up to {MOST_CUTS} different cuts")
    out = None
    for whole in (False, True):
        group = [n for n in names if (registry.reach(n).rows is None) == whole]
        if group:
            one = _compared(registry, group, tables, cuts, scramble, look, tolerance, whole)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no factors to replay")
    return out


def _compared(registry: Registry, names, tables, cuts, scramble, look, tolerance, whole) -> DataFrame:
    since = None
    if not whole and not scramble:
        reach = registry.farthest(names)
        found: list[dict] = [{} for _ in cuts]
        since = [dt.date.fromisoformat(min((registry.since(s, tables, str(cut), str(cut), reach, known) for s in registry.by_rows(names)), default=str(cut))) for cut, known in zip(cuts, found, strict=True)]
    # copies are written once: all plans read them, and none carries how they were made
    with registry.kept(names, copies(registry, names, tables, cuts, scramble, since)) as copied:
        return registry.each(names, copied, lambda d: _distances(d, cuts, scramble, look, tolerance))


def _distances(d: DataFrame, cuts, scramble, look, tolerance) -> DataFrame:
    """factor, cut, n, different, worst from the values of all copies."""
    if not scramble:  # what the windows give for other dates goes no further
        d = d.where(F.col("date").isin([cut + dt.timedelta(n * CYCLE) for i, cut in enumerate(cuts) for n in (0, i + 1)]))
    copy = F.element_at(F.split("code", "@"), -1).cast("int")
    d = d.select("factor", copy.alias("copy"), F.regexp_replace("code", "@[0-9]+$", "").alias("code"), F.date_sub("date", copy * CYCLE).alias("date"), "value")
    sides = []
    for i, cut in enumerate(cuts):
        day = F.lit(cut).cast("date")
        inside = F.col("date") == day if not scramble else (F.col("date") <= day) & (F.lit(True) if look is None else F.col("date") > F.date_sub(day, look))
        sides.append(F.when(F.col("copy").isin(0, i + 1) & inside, day))
    d = d.withColumn("cut", F.explode(F.array_compact(F.array(*sides))))
    own = F.col("copy") > 0
    both = d.groupBy("factor", "cut", "code", "date").agg(F.max(F.when(~own, F.col("value"))).alias("a"), F.max(F.when(own, F.col("value"))).alias("b"))
    near = F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.lit(1.0), F.abs("a"), F.abs("b"))
    differ = ~F.coalesce(near, F.col("a").eqNullSafe(F.col("b")))
    return both.groupBy("factor", "cut").agg(F.count("*").alias("n"), F.count(F.when(differ, 1)).alias("different"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"))

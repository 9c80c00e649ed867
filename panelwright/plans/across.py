"""Values across a date's codes, for whole sections at once: rows are dealt and sorted by date once, and any number of columns are ranked in numpy, where each ranking window would sort the section again and hold it.

A section has a row a code, so it fits one group whatever the table's length; a task holds one section at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from panelwright.shipping import ship


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys over as many tasks as spark.sql.shuffle.partitions says. The number is given, so that small sections aren't put together until a few tasks hold the whole table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sectioned(df: DataFrame, f: Callable, schema: T.StructType | str, *order: str) -> DataFrame:
    """f(table) for the rows of each date, in the order of the named columns."""
    ship(df.sparkSession)
    d = dealt(df, "date").sortWithinPartitions("date", *order)
    return d.mapInArrow(lambda batches: by_date(batches, f), schema)


def with_values(df: DataFrame, args: dict[str, Column], wanted: list[tuple[str, str, str]], kept: list[str], new: bool = True) -> DataFrame:
    """The kept columns (date among them) and the wanted ones: (name, kernel, which of args). new: rows don't yet lie by date."""
    ship(df.sparkSession)
    if new:
        df = dealt(df, "date")
    d = df.select(*kept, *[x.cast("double").alias(n) for n, x in args.items()])
    if new:
        d = d.sortWithinPartitions("date")
    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n, *_ in wanted])
    return d.mapInArrow(lambda batches: by_date(batches, lambda t: valued(t, kept, wanted)), schema)


def by_date(batches, f):
    """Batches of f(table) for each run of rows of one date."""
    import pyarrow as pa

    def done(parts):
        with np.errstate(all="ignore"):
            return f(pa.Table.from_batches(parts)).combine_chunks().to_batches()

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        day = batch["date"].cast(pa.int32()).fill_null(-(2**31)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(day)], strict=True):
            if held and day[a] != last:
                yield from done(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = day[a]
    if held:
        yield from done(held)


def column(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values and whether they are not null."""
    c = table[name]
    return c.fill_null(0).to_numpy(), c.is_valid().to_numpy()


def valued(table, kept, wanted):
    import pyarrow as pa

    out = [table[c] for c in kept]
    for _, kernel, arg in wanted:
        x, there = KERNELS[kernel](*column(table, arg))
        out.append(pa.array(x, mask=~there))
    return pa.table(out, [*kept, *[n for n, *_ in wanted]])


def _ties(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, the place where each run of equal ones starts, its length, and each sorted value's run. NaN is the greatest and equals itself."""
    order = np.argsort(x)
    s = x[order]
    new = np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))][: len(s)]
    at = np.flatnonzero(new)
    return order, at, np.diff(np.r_[at, len(s)]), np.cumsum(new) - 1


def rank(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Competition ranks among the values that are there."""
    order, at, _, run = _ties(x[there])
    got, out = np.empty(len(order)), np.zeros(len(x))
    got[order] = at[run] + 1.0
    out[there] = got
    return out, there


def rank_pct(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks over the number of values, as xs.rank_pct."""
    order, at, size, run = _ties(x[there])
    got, out = np.empty(len(order)), np.zeros(len(x))
    got[order] = ((at + 1 + (size - 1) / 2) / max(len(order), 1))[run]
    out[there] = got
    return out, there


def scale(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values over the sum of their sizes, as xs.scale."""
    out = x / np.abs(x[there]).sum()
    return out, there & np.isfinite(out)


def settled(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rank_pct of values that lie apart by rounding dust alone as ties, as formulas.settled."""
    return rank_pct(np.rint(x * 1e9), there)


KERNELS = {"rank": rank, "rank_pct": rank_pct, "scale": scale, "settled": settled}

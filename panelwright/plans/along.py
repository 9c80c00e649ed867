"""Window values along codes, for many rows at once: each step adds one row of every window, in the order that a window's rows have.

Sums and moments are built up as Spark's own aggregates build them, so values are those of `operators.ts` to the last
bit. Nulls are NaN here. A window has a value where all of its rows have one, unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from panelwright.operators import ts
from panelwright.shipping import ship

#: Rows whose windows are worked out together; a code is never cut.
BLOCK = 1 << 14


def _back(x: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The value k rows before each row of its code."""
    if k == 0:
        return x
    out = np.full(len(x), np.nan)
    out[k:] = x[:-k]
    out[place < k] = np.nan
    return out


def _moments(d: int, place, x, y=None):
    """(sum of squares of x, of y, of products) about the means of each window."""
    ax = ay = xx = yy = xy = np.zeros(len(x))
    for n in range(1, d + 1):
        v = _back(x, place, d - n)
        dx = v - ax
        if y is None:
            step = dx / n
            ax, xx = ax + step, xx + dx * (dx - step)
            continue
        u = _back(y, place, d - n)
        dy = u - ay
        ax, ay = ax + dx / n, ay + dy / n
        xy, xx, yy = xy + dx * (u - ay), xx + dx * (v - ax), yy + dy * (u - ay)
    return xx, yy, xy


def _sum(place, x, d):
    out = np.zeros(len(x))
    for k in range(d - 1, -1, -1):
        out = out + _back(x, place, k)
    return out


def _least(place, x, d):
    out = x
    for k in range(1, d):
        out = np.minimum(out, _back(x, place, k))
    return out


def _corr(place, x, y, d):
    both = np.isnan(x) | np.isnan(y)
    x, y = np.where(both, np.nan, x), np.where(both, np.nan, y)
    xx, yy, xy = _moments(d, place, x, y)
    varies = (_least(place, x, d) < -_least(place, -x, d)) & (_least(place, y, d) < -_least(place, -y, d))
    return np.where(varies, xy / np.sqrt(xx * yy), np.nan)


def _cov(place, x, y, d):
    both = np.isnan(x) | np.isnan(y)
    return _moments(d, place, np.where(both, np.nan, x), np.where(both, np.nan, y))[2] / (d - 1)


def _rank(place, x, d):
    x = np.rint(x * 1e9)
    below, same, there = np.zeros(len(x)), np.zeros(len(x)), ~np.isnan(x)
    for k in range(d):
        v = _back(x, place, k)
        below += v < x
        same += v == x
        there &= ~np.isnan(v)
    return np.where(there, (below + (same + 1) / 2) / d, np.nan)


def _argmax(place, x, d):
    """Place of the first greatest value; nulls are passed over."""
    low = np.where(np.isnan(x), -np.inf, x)
    best, at, some = _back(low, place, d - 1), np.zeros(len(x)), np.zeros(len(x), bool)
    for k in range(d - 1, -1, -1):
        v = _back(low, place, k)
        more = v > best
        best, at = np.where(more, v, best), np.where(more, d - 1 - k, at)
        some |= ~np.isnan(_back(x, place, k))
    return np.where(some & (place >= d - 1), at, np.nan)


def _decay(place, x, n):
    out = x * n
    for i in range(1, n):
        out = out + _back(x, place, i) * (n - i)
    return out / (n * (n + 1) / 2)


KERNELS = {
    "lag": lambda place, x, d=1: _back(x, place, d), "diff": lambda place, x, d=1: x - _back(x, place, d), "sum": _sum, "mean": lambda place, x, d: _sum(place, x, d) / d, "std": lambda place, x, d: np.sqrt(_moments(d, place, x)[0] / (d - 1)),
    "min": _least, "max": lambda place, x, d: -_least(place, -x, d), "corr": _corr, "cov": _cov, "argmax": _argmax, "tsrank": _rank, "decay": _decay,
}


class Looks:
    """Windows of rows near..near+d-1 before each row, whose nulls are passed over, as Spark's aggregates do. Each gives its values and whether there is one.

    columns: values and whether they are not null, by name; sizes: the rows of each code, one code after the other. Codes
    stand apart by as many nulls as windows reach back, so what lies k rows before is a slice.
    """

    def __init__(self, sizes: np.ndarray, reach: int, columns: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.pad = pad = min(reach, int(sizes.max()))
        self.at = np.arange(int(sizes.sum())) + pad * np.repeat(np.arange(len(sizes)), sizes)
        self.total, self.known, self.columns = len(self.at) + pad * len(sizes), {}, {}
        for name, (x, there) in columns.items():
            wide, some = np.zeros(self.total), np.zeros(self.total, bool)
            wide[self.at + pad], some[self.at + pad] = np.where(there, x, 0.0), there
            self.columns[name] = wide, some

    def get(self, how: str, d: int, last: int, *names: str) -> tuple[np.ndarray, np.ndarray]:
        x, there = self._get(how, d, -last, names)
        return x[self.at], there[self.at]

    def _get(self, how, d, near, names):
        key = (how, d, near, names)
        if key not in self.known:
            self.known[key] = getattr(self, how)(d, near, *names)
        return self.known[key]

    def _back(self, x, k):
        return x[self.pad - k : self.total - k]

    def _rows(self, d, near):
        """How far back the rows of a window lie, the oldest first; no code has rows further back than the nulls between."""
        return range(min(near + d - 1, self.pad), near - 1, -1)

    def _n(self, d, near, some):
        before, far = np.r_[0, np.cumsum(some)], min(near + d - 1, self.pad)
        if near > far:
            return np.zeros(self.total - self.pad, int)
        return before[self.pad - near + 1 : self.total - near + 1] - before[self.pad - far : self.total - far]

    def lag(self, d, near, name):
        x, there = self.columns[name]
        if near > self.pad:
            return np.zeros(self.total - self.pad), np.zeros(self.total - self.pad, bool)
        return self._back(x, near), self._back(there, near)

    def count(self, d, near, name):
        n = self._n(d, near, self.columns[name][1])
        return n.astype(float), np.ones(len(n), bool)

    def sum(self, d, near, name):
        x, there = self.columns[name]
        out = np.zeros(self.total - self.pad)
        for k in self._rows(d, near):
            out += self._back(x, k)
        return out, self._n(d, near, there) > 0

    def avg(self, d, near, name):
        total, some = self._get("sum", d, near, (name,))
        return total / self._n(d, near, self.columns[name][1]), some

    def _squares(self, d, near, name):
        x, there = self.columns[name]
        # a null stands for the mean so far, which changes nothing; the least number above 0 is lost in the first row's 1
        n, mean, out = np.full(self.total - self.pad, 1e-300), *np.zeros((2, self.total - self.pad))
        away, step = np.empty_like(n), np.empty_like(n)
        for k in self._rows(d, near):
            ok = self._back(there, k)
            n += ok
            np.copyto(away, mean)
            np.copyto(away, self._back(x, k), where=ok)
            away -= mean
            np.divide(away, n, out=step)
            mean += step
            np.subtract(away, step, out=step)
            step *= away
            out += step
        return self._n(d, near, there), out

    def stddev_samp(self, d, near, name):
        n, squares = self._squares(d, near, name)
        return np.sqrt(squares / (n - 1)), n > 1

    def stddev_pop(self, d, near, name):
        n, squares = self._squares(d, near, name)
        return np.sqrt(squares / n), n > 0

    def _extreme(self, d, near, name, of, none):
        x, there = self.columns[name]
        out, width, d = np.where(there, x, none), 1, len(self._rows(d, near))
        some = self._n(d, near, there) > 0
        if not d:
            return np.zeros(len(some)), some
        while width < d:
            more = min(width, d - width)
            out[more:], width = of(out[more:], out[:-more].copy()), width + more
        return self._back(out, near), some

    def max(self, d, near, name):
        return self._extreme(d, near, name, np.maximum, -np.inf)

    def min(self, d, near, name):
        return self._extreme(d, near, name, np.fmin, np.nan)

    def corr(self, d, near, first, second):
        (x, a), (y, b) = self.columns[first], self.columns[second]
        there = a & b
        n, (ax, ay, xx, yy, xy) = np.full(self.total - self.pad, 1e-300), np.zeros((5, self.total - self.pad))
        for k in self._rows(d, near):
            ok = self._back(there, k)
            n += ok
            v, u = np.where(ok, self._back(x, k), ax), np.where(ok, self._back(y, k), ay)
            dx, dy = v - ax, u - ay
            ax += dx / n
            ay += dy / n
            xy += dx * (u - ay)
            xx += dx * (v - ax)
            yy += dy * (u - ay)
        return xy / np.sqrt(xx * yy), self._n(d, near, there) > 1


def with_columns(df: DataFrame, columns: dict[str, Callable[[], Column]], later: str = "", ordered: bool = False) -> tuple[DataFrame, bool]:
    """df with the columns, whose windows along codes are worked out by Looks, and whether its rows still lie by code in date order.

    Of df's own columns those stay that the new ones or the text `later` name. ordered: rows lie by code in date order
    already. Windows over anything but doubles stay Spark's.
    """
    with ts.asking() as asked:
        made = {n: make() for n, make in columns.items()}
    if not asked:
        return df.withColumns(made), ordered and not any(map(_orders, made.values()))
    d, done = df, set()
    while len(done) < len(asked):
        names = {name for name, _ in asked.values()}
        some = {k: v for k, v in asked.items() if v[0] not in done and not any(n in str(x) for x in v[1] for n in names - done)}
        args = {str(x): x for _, xs in some.values() for x in xs}
        short = {text: f"_a{i}_" for i, text in enumerate(args)}
        with_args = d.withColumns({short[text]: x for text, x in args.items()})
        if any(not isinstance(with_args.schema[short[text]].dataType, T.DoubleType) for text in args):
            return df.withColumns({n: make() for n, make in columns.items()}), False
        rest = " ".join([later, *map(str, made.values()), *[str(x) for k, (name, xs) in asked.items() if name not in done and k not in some for x in xs]])
        kept = [n for n in d.columns if n in ("code", "date") or re.search(rf"\b{re.escape(n)}\b", rest)]
        if not ordered or any(map(_orders, args.values())):
            with_args = with_args.select(*kept, *short.values()).repartition("code").sortWithinPartitions("code", "date")
        with_args = with_args.select(*kept, *short.values())
        looks = [(name, key[0], key[1], key[2], [short[str(x)] for x in xs]) for key, (name, xs) in some.items()]
        schema = T.StructType([with_args.schema[c] for c in kept] + [T.StructField(name, T.DoubleType()) for name, *_ in looks])
        ship(df.sparkSession)
        d, ordered = with_args.mapInArrow(lambda batches, kept=kept, looks=looks: looked(batches, kept, looks), schema), True
        done |= {name for name, *_ in looks}
    windows = [name for name, _ in asked.values()]
    return d.withColumns(made).drop(*windows), not any(map(_orders, made.values()))


def _orders(x: Column) -> bool:
    """Whether a column holds a window of Spark's, which leaves rows in another order."""
    return bool(re.search(r"\bover\b|windowspec|unboundedpreceding", str(x), re.IGNORECASE))


def looked(batches, kept: list[str], looks: list[tuple[str, str, int, int, list[str]]]):
    """Batches of the kept columns and of windows (name, how, rows, last row, columns), from rows that are ordered by code and date."""
    import pyarrow as pa

    reach = max(d - 1 - last if how != "lag" else -last for _, how, d, last, _ in looks)

    def done(table, place):
        first = np.flatnonzero(place == 0)
        sizes = np.diff(np.r_[first, len(place)])
        read = {c: (table[c].fill_null(0.0).to_numpy(), table[c].is_valid().to_numpy()) for c in {c for *_, columns in looks for c in columns}}
        x, there = np.zeros((len(looks), len(place))), np.zeros((len(looks), len(place)), bool)
        # codes of about the same length together, as the nulls between are as many as the longest has rows
        alike = np.ceil(np.log2(sizes))
        for a in np.unique(alike):
            rows = np.flatnonzero(np.repeat(alike == a, sizes))
            at = Looks(sizes[alike == a], reach, {c: (v[rows], ok[rows]) for c, (v, ok) in read.items()})
            for i, (_, how, d, last, columns) in enumerate(looks):
                x[i, rows], there[i, rows] = at.get(how, d, last, *columns)
        return pa.table([*[table[c] for c in kept], *[pa.array(v, mask=~ok) for v, ok in zip(x, there, strict=True)]], [*kept, *[name for name, *_ in looks]])

    yield from by_code(batches, done)


def values(batches, kept: list[str], wanted: list[tuple[str, str, list[str], tuple]]):
    """Batches of the kept columns and of the wanted ones (name, kernel, columns it reads, its numbers), from rows that are ordered by code and date."""
    import pyarrow as pa

    def done(table, place):
        read = {c: table[c].to_numpy() for c in {c for _, _, columns, _ in wanted for c in columns}}
        out = [table[c] for c in kept]
        for _, kernel, columns, numbers in wanted:
            x = KERNELS[kernel](place, *[read[c] for c in columns], *numbers)
            out.append(pa.array(x, mask=~np.isfinite(x)))
        return pa.table(out, [*kept, *[w[0] for w in wanted]])

    yield from by_code(batches, done)


def by_code(batches, done, block: int | None = None):
    """done(table, place of each row in its code) for about `block` (BLOCK) rows at a time, codes whole."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def batched(table, start):
        place = np.arange(table.num_rows) - np.repeat(start, np.diff(np.r_[start, table.num_rows]))
        with np.errstate(all="ignore"):
            return done(table, place).combine_chunks().to_batches()

    def starts(table):
        code = table["code"].combine_chunks()
        code = code if isinstance(code, pa.Array) else pa.concat_arrays(code.chunks)
        return np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(code[1:], code[:-1]))) + 1]

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < (block or BLOCK):
            continue
        table = pa.Table.from_batches(held)
        start = starts(table)
        if len(start) > 1:
            yield from batched(table.slice(0, int(start[-1])), start[:-1])
            table = table.slice(int(start[-1]))
        held, rows = table.to_batches(), 0
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield from batched(table, starts(table))

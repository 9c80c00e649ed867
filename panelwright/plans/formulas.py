"""Formula factors: expressions over a panel, planned together.

An expression is a node; equal nodes are one node, so formulas share their parts. Nodes that look along a
code (time series) or across a date (cross section) are put into phases that alternate between the two, and
each phase is one exchange for all formulas, however many there are and however deep they nest inside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import elementwise as el
from panelwright.operators import panel, ts, xs
from panelwright.plans import across, along
from panelwright.shipping import ship
from panelwright.sources.folders import fresh, remove, written


class Node:
    """A part of a formula; the usual operators make new ones."""

    _known: dict = {}

    def __new__(cls, kind: str, build: Callable[..., Column], args: tuple = (), key: tuple = ()):
        full = (kind, key, tuple(id(a) for a in args))
        if full not in cls._known:
            n = super().__new__(cls)
            n.kind, n.build, n.args, n.key = kind, build, args, key
            low = max((a.phase for a in args), default=0)
            # Phases: 0 columns as they are, odd ones along codes, even ones across dates.
            n.phase = low if kind == "el" else low + (low % 2 == 0) if kind == "ts" else max(2, low + low % 2)
            n.depth = 0 if not args else max(a.depth for a in args) + (kind != "el")
            n.name = f"_n{len(cls._known)}"
            cls._known[full] = n
        return cls._known[full]

    def _with(self, other, name: str, f) -> Node:
        return Node("el", f, (self, node(other)), (name,))

    def __add__(self, o):
        return self._with(o, "+", lambda a, b: a + b)

    def __radd__(self, o):
        return node(o) + self

    def __sub__(self, o):
        return self._with(o, "-", lambda a, b: a - b)

    def __rsub__(self, o):
        return node(o) - self

    def __mul__(self, o):
        return self._with(o, "*", lambda a, b: a * b)

    def __rmul__(self, o):
        return node(o) * self

    def __truediv__(self, o):
        return self._with(o, "/", el.safe_div)

    def __rtruediv__(self, o):
        return node(o) / self

    def __neg__(self):
        return Node("el", lambda a: -a, (self,), ("neg",))

    def __gt__(self, o):
        return self._with(o, ">", lambda a, b: a > b)

    def __lt__(self, o):
        return self._with(o, "<", lambda a, b: a < b)

    def __le__(self, o):
        return self._with(o, "<=", lambda a, b: a <= b)


def node(x) -> Node:
    return x if isinstance(x, Node) else Node("el", lambda: F.lit(float(x)), (), ("lit", float(x)))


def column(name: str) -> Node:
    return Node("el", lambda: F.col(name), (), ("col", name))


def _along(name: str, f):
    return lambda *a: Node("ts", lambda *c: f(*c, *[p for p in a if not isinstance(p, Node)]), tuple(p for p in a if isinstance(p, Node)), (name, *[p for p in a if not isinstance(p, Node)]))


LAG, DIFF, MEAN, STD, SUM = _along("lag", ts.delay), _along("diff", ts.delta), _along("mean", ts.mean), _along("std", ts.std), _along("sum", ts.total)
MIN, MAX, CORR, COV, ARGMAX = _along("min", ts.low), _along("max", ts.high), _along("corr", ts.corr), _along("cov", ts.cov), _along("argmax", ts.argmax)


def settled(x: Column) -> Column:
    """What ranks compare: values that lie apart by rounding dust alone are ties, as a correlation of two points is 1 or -1 but for the last bits."""
    return F.rint(x * 1e9)


TSRANK = _along("tsrank", lambda x, d: ts.rank(settled(x), d))


DECAY = _along("decay", ts.decay_linear)


def XRANK(x: Node) -> Node:
    return Node("xs", lambda a: xs.rank_pct(settled(a)), (x,), ("rank",))


def XSCALE(x: Node) -> Node:
    return Node("xs", xs.scale, (x,), ("scale",))


#: The kernels of nodes across a date.
ACROSS = {"rank": "settled", "scale": "scale"}


def _each(name: str, f):
    return lambda *a: Node("el", f, tuple(node(x) for x in a), (name,))


ABS, SGN, LN, IF, GT, LT = _each("abs", F.abs), _each("sgn", F.signum), _each("ln", el.guarded_log), _each("if", el.if_else), _each("gt", el.pair_max), _each("lt", el.pair_min)


def _looked_back(d: DataFrame, nodes: list[Node], args: dict[Node, Column], kept: list[str], new: bool) -> DataFrame:
    """The kept columns and those of nodes along codes. new: rows are not yet dealt by code and in order."""
    names = {a: f"_a{i}" for i, a in enumerate(args)}
    wanted = [(n.name, n.key[0], [names[a] for a in n.args], n.key[1:]) for n in nodes]
    if new:
        d = d.repartition("code").sortWithinPartitions("code", "date")
    d = d.select(*kept, *[x.cast("double").alias(names[a]) for a, x in args.items()])
    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField(n.name, T.DoubleType()) for n in nodes])
    ship(d.sparkSession)
    return d.mapInArrow(lambda batches: along.values(batches, kept, wanted), schema)


def evaluate(bars: DataFrame, formulas: dict[str, Node]) -> DataFrame:
    """code, date and one column a formula. bars holds the columns that the formulas name; put it on a dense grid first."""
    wanted: dict[str, Node] = {}

    def visit(n: Node) -> None:
        for a in n.args:
            visit(a)
        if n.kind != "el":
            wanted[n.name] = n

    for f in formulas.values():
        visit(f)

    made: dict[str, Column] = {}  # those of the present step

    def value(n: Node, done: set[str]) -> Column:
        if n.name not in made:
            made[n.name] = F.col(n.name) if n.name in done else n.build(*[value(a, done) for a in n.args])
        return made[n.name]

    def reads(n: Node) -> set[str]:
        """The columns that a node's value is made of, where what it looks back on is a column already."""
        if n.kind != "el":
            return {n.name}
        return {n.key[1]} if n.key[:1] == ("col",) else {c for a in n.args for c in reads(a)}

    done: set[str] = set()
    d = bars
    steps = sorted({(n.phase, n.depth) for n in wanted.values()})
    for i, (phase, depth) in enumerate(steps):
        now = [n for n in wanted.values() if (n.phase, n.depth) == (phase, depth)]
        new = i == 0 or steps[i - 1][0] != phase
        later = {c for f in formulas.values() for c in reads(f)} | {c for n in wanted.values() if (n.phase, n.depth) in steps[i + 1 :] for a in n.args for c in reads(a)}
        kept = ["code", "date", *[c for c in d.columns if c in later and c not in ("code", "date")]]
        if phase % 2 == 0:
            args = {a: value(a, done) for n in now for a in n.args}
            names = {a: f"_a{k}" for k, a in enumerate(args)}
            d = across.with_values(d, {names[a]: x for a, x in args.items()}, [(n.name, ACROSS[n.key[0]], names[n.args[0]]) for n in now], kept, new)
        else:
            d = _looked_back(d, now, {a: value(a, done) for n in now for a in n.args}, kept, new)
        done |= {n.name for n in now}
        made.clear()
    return d.select("code", "date", *[el.finite(value(f, done).cast("double")).alias(name) for name, f in formulas.items()])


def exchanges(formulas: dict[str, Node]) -> int:
    """How many exchanges evaluate() plans."""

    def phases(n: Node) -> set[int]:
        return {n.phase} - {0} | {p for a in n.args for p in phases(a)}

    return len({p for f in formulas.values() for p in phases(f)})


o, h, lo, c, vw, v, ret = (column(x) for x in ("open", "high", "low", "close", "vwap", "volume", "ret"))
_NAMED = {"open": o, "high": h, "low": lo, "close": c, "vwap": vw, "volume": v}

# The formulas' numbers, inputs and windows.
#: minus the correlation of two inputs
PLAIN = {6: ("open", "volume", 10), 126: ("close", "volume", 10), 127: ("close", "volume", 20), 145: ("close", "volume", 10), 147: ("low", "volume", 5), 148: ("high", "volume", 5), 149: ("vwap", "volume", 5), 150: ("close", "volume", 3), 151: ("open", "volume", 3), 152: ("high", "volume", 3), 153: ("low", "volume", 3), 154: ("vwap", "volume", 3), 175: ("open", "volume", 10), 189: ("close", "volume", 60)}
#: minus the correlation of two inputs' ranks over the date
RANKED = {105: ("open", "volume", 10), 117: ("close", "volume", 2), 125: ("close", "volume", 5), 129: ("open", "volume", 5), 133: ("high", "volume", 10), 134: ("close", "volume", 10), 144: ("close", "volume", 3), 169: ("close", "volume", 10), 171: ("close", "volume", 5), 172: ("high", "volume", 10), 173: ("low", "volume", 10), 174: ("vwap", "volume", 10)}
#: minus the rank of that correlation
RANK_OF_RANKED = {119: ("vwap", "volume", 5), 128: ("vwap", "volume", 10), 130: ("open", "volume", 3), 131: ("high", "volume", 3), 137: ("low", "volume", 5)}
#: minus the rank of the plain correlation
RANK_OF_PLAIN = {116: ("high", "volume", 5), 120: ("close", "volume", 5), 135: ("close", "volume", 5), 143: ("close", "volume", 3), 146: ("open", "volume", 10)}
#: minus the correlation of two inputs' ranks within their own windows
OWN_RANKS = {138: ("close", 5), 139: ("open", 5), 140: ("high", 5), 141: ("low", 5), 142: ("vwap", 5), 181: ("close", 10), 182: ("open", 10), 183: ("high", 10), 184: ("low", 10), 185: ("vwap", 10)}
#: minus the correlation of means (first four) or sums of close and volume: window of the mean, window of the correlation
SMOOTHED = {176: (MEAN, 5, 5), 177: (MEAN, 10, 10), 178: (MEAN, 20, 10), 113: (SUM, 5, 5), 190: (SUM, 10, 10), 191: (SUM, 20, 20)}
#: minus the rank over the date of a time-series value
RANK_OF = {82: lambda: o - c, 106: lambda: c - o, 121: lambda: (c - o) * v, 124: lambda: c / LAG(c, 20) - 1, 163: lambda: vw - c, 164: lambda: MEAN(v, 5) / MEAN(v, 20), 165: lambda: v / MEAN(v, 20) - 1, 166: lambda: MAX(h, 5) / c - 1, 167: lambda: c / MIN(lo, 5) - 1, 168: lambda: STD(ret, 20), 187: lambda: STD(ret, 60)}

#: minus the rank within its window of a plain correlation: two inputs, window of the correlation, window of the rank
TIMED_CORR = {93: (lambda: vw, lambda: MEAN(v, 20), 6, 8), 95: (lambda: MEAN(h, 20), lambda: MEAN(v, 20), 5, 3), 115: (lambda: h, lambda: v, 5, 5), 64: (lambda: XRANK(LAG(MEAN(h, 10), 5) / MEAN(h, 10) - 1), lambda: XRANK(v), 2, 3), 68: (lambda: XRANK(MEAN(h, 15) / STD(h, 15)), lambda: XRANK(v), 5, 5), 70: (lambda: XRANK(c), lambda: XRANK(v), 2, 3), 75: (lambda: XRANK(v), lambda: XRANK(vw), 2, 5), 78: (lambda: LAG(lo - c, 1), lambda: LAG(c - o, 1), 2, 5), 96: (lambda: XRANK(c), lambda: XRANK(MEAN(v, 10)), 5, 4)}
#: minus the rank over the date of a correlation
CORR_RANKED = {74: (lambda: LAG((lo + h) / 2, 8), lambda: XRANK(MEAN(lo, 6)), 8), 87: (lambda: XRANK(lo), lambda: XRANK(MEAN(v, 20)), 3), 90: (lambda: XRANK((c - MIN(lo, 5)) / (MAX(h, 5) - MIN(lo, 5))), lambda: XRANK(v), 5), 99: (lambda: SUM((h + lo) / 2, 20), lambda: SUM(MEAN(v, 60), 20), 5)}
#: means of prices and of their changes that the close is held against
BANDS = {46: (3, 5, 10, 15, 20, 30, 35, 40, 45, 50), 69: (2, 5, 10, 15, 20, 30, 40, 50, 60, 90, 120)}
#: how a correlation of ranks is taken over a window, with the sign: first input, window of the correlation, window
OVER_RANKED = {110: (lambda x, d: -MAX(x, d), lambda: c, 5, 5), 111: (lambda x, d: -MIN(x, d), lambda: o, 5, 5), 112: (lambda x, d: -MEAN(x, d), lambda: c, 5, 5), 136: (lambda x, d: -MEAN(x, d), lambda: c, 10, 10), 108: (lambda x, d: -XRANK(MEAN(x, d)), lambda: h, 2, 2), 15: (lambda x, d: -SUM(XRANK(x), d), lambda: h, 3, 3)}


def rest() -> dict[int, Node]:
    """The formulas that no table covers, other than those of library()."""
    one, up = node(1), IF(c <= LAG(c, 1), 1, -1)
    band = lambda n: (c - MIN(lo, n)) / (MAX(h, n) - MIN(lo, n))
    fifth = lambda x: x * x * x * x * x
    place = ((c - lo) - (h - c)) / (h - lo)
    tide = CORR(SUM(MEAN(lo, 50), 9) / 9, SUM(MEAN(h, 50), 9) / 9, 8)
    lagging = CORR(LAG(c, 1), MEAN(v, 20), 4)
    gap, spread = o - SUM(vw, 9) / 9, c - h + lo
    from20, long_mean = c - MEAN(c, 20), MEAN(c, 100)
    excess = ret - (MEAN(ret, 240) + STD(ret, 240) * 2.4)
    away = lambda n: (MAX(h, n) - c + (c - MIN(lo, n))) / (MAX(h, n) - MIN(lo, n)) * -CORR(v, c, 3)
    gain5 = SUM(o, 5) * SUM(ret, 5)
    weaker = XRANK(CORR(XRANK(h), XRANK(v), 3))
    far4 = c - MEAN(c, 4)
    return {
        5: XRANK(gap) * -XRANK(ABS(gap)), 8: -XRANK(DIFF(gain5, 4)), 9: IF(LT(weaker, XRANK(DIFF(c, 1))) > 0, DIFF(c, 1), -DIFF(c, 1)), 10: -XRANK(GT(IF(ret > 0, STD(ret, 20), c), c)),
        11: (XRANK(GT((MAX(c, 3) - c) / (c - MIN(c, 3)), 0)) * 3 - 1) * (XRANK(SUM(ret, 3)) * TSRANK(ABS(vw / c - 1), 5)), 14: -XRANK(DIFF(ret * v, 3)) * TSRANK(CORR(o, v, 10), 10), 17: XRANK(TSRANK(MAX(vw - c, 2), 2)) + TSRANK(-DIFF(c, 2), 5) + XRANK(v / LAG(v, 1) - 1),
        18: -XRANK(CORR(c, o, 6)) * SGN(STD(ABS(c / LAG(o, 6) - 1), 20)), 19: -SGN(IF(c < LAG(c, 5), ABS(c - LAG(c, 5)), 1)), 20: -(XRANK(o - LAG(o, 6)) + XRANK(lo - LAG(lo, 6)) + XRANK(h - LAG(h, 6)) - XRANK(c - LAG(c, 6))), 21: IF(MEAN(c, 20) < LAG(MEAN(c, 20), 1), -(from20 / STD(c, 20)), from20 / STD(c, 20)),
        22: -DIFF(DIFF(CORR(h, v, 5), 5) * XRANK(STD(c, 20)), 5), 23: IF(MEAN(h, 20) < MEAN(h, 60), -1, 1) * XRANK(-DIFF(c, 1)), 24: -DIFF(TSRANK(DIFF(long_mean, 100) / LAG(long_mean, 100), 5), 3) / (c - LAG(c, 12)), 25: IF(XRANK(tide) < 0.5, -1, 1) * (XRANK(-TSRANK(ret, 15)) * 2),
        26: -MAX(CORR(TSRANK(v, 5), TSRANK(h, 5), 5), 3), 27: IF(XRANK(XRANK(COV(XRANK(c), XRANK(v), 2)) / XRANK(COV(XRANK(c), XRANK(v), 10))) > 0.5, -1, 1), 29: -(XRANK(LAG(TSRANK(COV(XRANK(lo), XRANK(v), 3), 5), 5)) + XRANK(-DIFF(c, 3))), 30: (1 - XRANK(MEAN(CORR(c, v, 10), 5))) * up * v / MEAN(v, 20),
        31: -((XRANK(XRANK(XRANK(CORR(XRANK(c), XRANK(v), 13)))) + 1) / XRANK((c - lo) - (h - c))), 32: XSCALE(-SGN(MEAN(c, 7) - c + 1e-12) * (3 * ABS(MEAN(c, 7) - c) / MEAN(ABS(ret), 20) + 1)), 33: -XRANK(SUM(IF(o / c - 1 > 0, 1, -1) * v, 5)) * TSRANK(ABS(from20), 5),
        35: TSRANK((1 - XRANK(((h + lo) / 2 - MEAN(h, 12)) / 11)) * 3 - TSRANK(CORR(c, v, 5), 2) * TSRANK(v, 32), 16), 36: TSRANK(-CORR(XRANK(v), XRANK(c), 5), 5) + 2 * XRANK(TSRANK(ABS(c - MEAN(c, 15)), 15)) - XRANK(SUM(o, 5) - SUM(o, 20)) - 0.5, 37: XRANK(CORR(LAG(o - c, 1), c, 200)) + XRANK(o - c),
        38: XRANK(TSRANK(MEAN(h, 10) / STD(h, 10), 2)) * SGN(DIFF(c, 1)), 39: -XRANK(spread - LAG(spread, 1)) * (1 + XRANK(TSRANK(LAG(spread, 7), 30) - TSRANK(spread, 30))), 40: -XRANK(MAX(IF(c <= LAG(c, 1), STD(h, 20), c), 20)), 41: -(XRANK(MAX(DIFF(vw, 3), 25)) * XRANK(MAX(DIFF(vw, 3), 25))),
        42: XRANK(v / LAG(v, 1) - 1) * XRANK(h - lo) / c, 44: -CORR(XRANK(MIN(lo, 5) / LAG(MIN(lo, 5), 5) * 1000 - 1000), XRANK(v), 2), 45: -XRANK(MEAN(LAG(c, 5), 20)) * CORR(c, v, 2) * XRANK(CORR(SUM(c, 5), SUM(c, 20), 2)), 47: XRANK(CORR(XRANK(vw), XRANK(v), 5)) - XRANK(1 / MEAN(c, 4) * 100),
        48: -(CORR(excess, ret, 10) / (STD(excess, 10) * STD(ret, 10))), 49: IF((h + lo) / 2 < LAG(MEAN(h, 5), 1), -((h + lo) / 2), (h + lo) / 2), 50: away(6), 51: away(12), 52: TSRANK(-CORR(XRANK(LAG(MIN(lo, 5), 5) / MIN(lo, 60) * 1000 - 1000), XRANK(v / MEAN(v, 5)), 2), 5), 53: -DIFF(1 - ((c - lo) - (h - c)) / (c - lo), 9), 54: -(((lo - c) * fifth(h)) / ((lo - h) * fifth(c))), 55: -CORR(XRANK(band(12)), XRANK(v), 6),
        56: XRANK(SUM(o, 20) - SUM(o, 10)) * XRANK(SUM(ret, 10) - LAG(SUM(ret, 10), 10)), 57: (1 - (c - MIN(c, 3)) / (MAX(c, 3) - MIN(c, 3))) * (1 - (c - MIN(c, 3)) / (MAX(c, 3) - MIN(c, 3))) * TSRANK(v, 5), 58: -TSRANK(COV(XRANK(c), XRANK(v), 2), 2), 59: -SUM(IF(place > 0, 1, -1) * v / MEAN(v, 20), 20),
        60: -(1 - XRANK(SUM(place * v, 20) / SUM(v, 20))) * TSRANK(CORR(c, v, 3), 5), 61: -XRANK(TSRANK(MAX(vw - c, 20), 22)), 62: CORR(XRANK(c), XRANK(v), 3) * DIFF(XRANK(-CORR(c, v, 5)), 2), 63: -TSRANK(COV(XRANK(c), XRANK(v), 4), 4), 65: -MEAN(CORR(SUM(c, 20), SUM(c, 40), 4), 4), 66: -XRANK(fifth(DIFF(c, 7))),
        67: -(XRANK(TSRANK(CORR(XRANK(h), XRANK(v), 2), 4) - TSRANK(DIFF(c, 1), 2)) + 1), 71: -TSRANK(LAG(c - MEAN(c, 45), 2), 45), 72: -XRANK(-(XRANK(ABS(c - MEAN(c, 5))) / (MAX(h, 6) - MIN(lo, 6)))), 76: -XRANK(LAG(DIFF(c, 1), 4)) * TSRANK(COV(c, MEAN(v, 60), 2), 5) / TSRANK(STD(c, 22), 5),
        77: XRANK(CORR((h + lo) / 2, MEAN(c, 40), 2)) * XRANK(1 / MIN(h, 40)), 79: -XRANK(DIFF(vw, 3)) * TSRANK(CORR(c, v, 7), 5), 80: -(XRANK(SGN(DIFF(c * 0.9, 1))) * XRANK(CORR(MEAN(h, 10), MEAN(v, 60), 2))), 81: -(TSRANK(LN(v), 2) * XRANK(CORR(c, MEAN(v, 20), 2))), 83: XRANK(MEAN(LAG(v, 5), 20) * (h - lo) / (MAX(h, 5) - MIN(lo, 5))),
        84: -TSRANK(SGN(lagging), 5), 85: -TSRANK(SGN(lagging), 5) * (TSRANK(CORR(XRANK(h), XRANK(v), 30), 9) + XRANK(CORR(XRANK(c), XRANK(v), 60))), 86: -(IF(MEAN(c, 15) + STD(c, 20) < MEAN(c, 200), -1, 1) * DIFF(c, 1)), 88: -XRANK(LAG(band(10), 1)), 89: IF(MEAN(c, 10) < MEAN(c, 120), 1, -1) * (1 - XRANK(MEAN(CORR(MEAN(lo, 10), MEAN(v, 10), 4), 4))),
        91: -(XRANK(MEAN(c, 5) - c) * STD(c, 5) * CORR(c, v, 2)), 92: IF(XRANK(CORR(XRANK(MAX(c, 30)), XRANK(MIN(lo, 30)), 5)) < 0.2, -1, 1) * XRANK(CORR(far4, LAG(far4, 1), 5)), 94: -(IF(XRANK(tide) < 0.5, 1, -1) * from20), 97: -TSRANK(LAG(STD(c, 10), 5), 10), 98: TSRANK(CORR(v, c, 5), 5) * XRANK((LAG(long_mean, 100) - long_mean) / LAG(long_mean, 100)),
        100: -(XRANK(CORR(XRANK(LAG(MEAN(lo, 5), 5) / MEAN(lo, 5) - 1), XRANK(v), 2)) + one - XRANK(STD(h, 20) / MEAN(h, 20))), 102: -DIFF(XRANK(CORR(XRANK(v), XRANK(c), 3)), 1), 104: -DIFF(CORR(XRANK(h), XRANK(v), 5), 5), 107: -TSRANK(o - h, 2) * XRANK(TSRANK(CORR(c, v, 3), 2)), 114: XRANK(DIFF(vw, 1)) * CORR(c, v, 5), 123: XRANK(CORR(SUM(lo, 15), SUM(v, 15), 5)),
        170: -CORR(c, MEAN(v, 10), 5),
    }


def library() -> dict[str, Node]:
    """The formulas by number, from the tables above and those that stand alone."""
    n = _NAMED
    out: dict[int, Node] = {}
    out |= {k: -CORR(n[a], n[b], d) for k, (a, b, d) in PLAIN.items()}
    out |= {k: -CORR(XRANK(n[a]), XRANK(n[b]), d) for k, (a, b, d) in RANKED.items()}
    out |= {k: -XRANK(CORR(XRANK(n[a]), XRANK(n[b]), d)) for k, (a, b, d) in RANK_OF_RANKED.items()}
    out |= {k: -XRANK(CORR(n[a], n[b], d)) for k, (a, b, d) in RANK_OF_PLAIN.items()}
    out |= {k: -CORR(TSRANK(n[a], d), TSRANK(v, d), d) for k, (a, d) in OWN_RANKS.items()}
    out |= {k: -CORR(f(c, d), f(v, d), e) for k, (f, d, e) in SMOOTHED.items()}
    out |= {k: -XRANK(f()) for k, f in RANK_OF.items()}
    out |= {k: -TSRANK(CORR(a(), b(), d), e) for k, (a, b, d, e) in TIMED_CORR.items()}
    out |= {k: -XRANK(CORR(a(), b(), d)) for k, (a, b, d) in CORR_RANKED.items()}
    out |= {k: f(CORR(XRANK(x()), XRANK(v), d), e) for k, (f, x, d, e) in OVER_RANKED.items()}
    for k, windows in BANDS.items():  # c * 0 keeps rows without a close out of the ranks
        above = sum((IF(c > MEAN(c, m) + MEAN(DIFF(c, 1), m), 1, 0) for m in windows), c * 0)
        out[k] = -(XRANK(above / len(windows)) - 0.5)
    out |= rest()
    place = ((c - lo) - (h - c)) / (h - lo)
    down = c <= LAG(c, 1)
    out |= {
        1: -CORR(XRANK(DIFF(LN(v), 1)), XRANK((c - o) / o), 6), 2: -DIFF(place, 1), 3: -SUM(IF(down, v, v * 0), 20), 4: -TSRANK(XRANK(CORR(XRANK(vw), XRANK(v), 6)), 9),
        7: place * v / SUM(v, 21) * 20, 12: SGN(DIFF(v, 1)) * -DIFF(c, 1), 13: -XRANK(COV(XRANK(c), XRANK(v), 5)), 16: -XRANK(COV(XRANK(h), XRANK(v), 5)), 28: XSCALE(LN(((CORR(MEAN(lo, 20), MEAN(v, 20), 5) * (h + lo)) / 2 - c) * 1000)),
        34: XRANK((MEAN(c, 2) / MEAN(c, 100) - 1) * 100), 43: TSRANK(IF(c > LAG(c, 1), v, -v), 20), 73: -TSRANK(-XRANK(COV(XRANK((MAX(c, 5) - c) / (c - MIN(c, 5))), XRANK(v), 5)), 3), 101: (c - o) / ((h - lo) + 1e-12), 103: -((20 - ARGMAX(lo, 20)) / 20),
        109: -(STD(h, 10) / c), 118: -(SUM(h - o, 20) / SUM(o - lo, 20)), 122: -(STD(c, 5) / STD(c, 60)), 132: -((c - LAG(c, 10)) / LAG(c, 10)), 155: -SUM(SGN(c - LAG(c, 1)) * v, 5), 156: -SUM(IF(c > LAG(c, 1), v, -v), 10),
        157: -DIFF(MEAN(c, 5) / MEAN(c, 20), 1), 158: -DIFF(MEAN(v, 5) / MEAN(v, 20), 1), 159: -TSRANK(ret, 10), 160: TSRANK(-ret, 5), 161: -TSRANK(STD(ret, 10), 10), 162: -DIFF(c, 1), 179: -(MEAN(c, 20) / c - 1), 180: -(MEAN(c, 60) / c - 1), 186: -TSRANK(CORR(c, v, 20), 10), 188: -SUM(ABS(ret), 20) / SUM(ABS(ret), 120),
    }
    return {f"a{k:03d}": out[k] for k in sorted(out)}


def replicas() -> dict[str, Node]:
    """Four formulas of another public set; its 88th takes the first part where the second has no value."""
    t1 = XRANK(DECAY((XRANK(o) + XRANK(lo)) - (XRANK(h) + XRANK(c)), 8))
    t2 = TSRANK(DECAY(CORR(TSRANK(c, 8), TSRANK(MEAN(v, 60), 21), 8), 7), 3)
    least = Node("el", lambda a, b: F.when(b.isNull() | (a <= b), a).otherwise(b), (t1, t2), ("first unless second is less",))
    return {"pa_a101_040": -XRANK(STD(h, 10)) * CORR(h, v, 10), "pa_a101_044": -CORR(h, XRANK(v), 5), "pa_a101_088": least, "pa_5d_min_low_ratio": MIN(lo, 5) / c}


def prepared(bars: DataFrame) -> DataFrame:
    """Bars (code, date, open, high, low, close, vol, amount) on the dense grid with the names that formulas use."""
    d = panel.dense(bars).withColumns({"vwap": el.safe_div(F.col("amount"), F.col("vol")), "volume": F.col("vol")})
    return d.withColumn("ret", ts.change("close", 1))


#: Formulas of one plan; a larger batch is several, as the time to plan grows faster than their number.
TOGETHER = 24


def batch(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(date, code, factor, value) of the named formulas, or of the whole library; rows without a value are left out.

    Up to TOGETHER formulas are one plan; the plans of a larger batch start from the same exchanged panel.
    """
    lib = library() | replicas() if names else library()
    # those that are alike stand together, so that a plan has few phases and shares parts
    order = sorted(names or lib, key=lambda k: (lib[k].phase, k))
    ready, out = prepared(bars), None
    for i in range(0, len(order), TOGETHER):
        chosen = {k: lib[k] for k in order[i : i + TOGETHER]}
        wide = evaluate(ready, chosen)
        long = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("value")) for k in chosen]))
        part = wide.select("date", "code", long.alias("x")).select("date", "code", "x.factor", "x.value").where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


#: Columns that the exchanges of one plan may carry, all of them counted: their files stand until the plan has run. Small panels may have plans of so many bytes instead.
WIDTH, SMALL = 32, 4 << 30


def carried(formulas: list[Node]) -> int:
    """How many columns the exchanges of one plan of these formulas carry, and that back to codes if the last is across dates."""
    wanted: dict[str, Node] = {}
    read: dict[str, set[str]] = {}

    def visit(n: Node) -> None:
        if n.name not in read:
            for a in n.args:
                visit(a)
            if n.kind != "el":
                wanted[n.name] = n
            read[n.name] = {n.name} if n.kind != "el" else {n.key[1]} if n.key[:1] == ("col",) else set().union(*(read[a.name] for a in n.args))

    for f in formulas:
        visit(f)
    total, phases = 0, sorted({n.phase for n in wanted.values()})
    for phase in phases:
        later = set().union(*(read[f.name] for f in formulas), *(read[a.name] for n in wanted.values() if n.phase >= phase for a in n.args))
        total += sum(c not in wanted or wanted[c].phase < phase for c in later)
    return total + (len(formulas) if phases and phases[-1] % 2 == 0 else 0)


def grouped(lib: dict[str, Node], width: int = WIDTH) -> list[dict[str, Node]]:
    """The formulas in groups of one plan each: at most TOGETHER, and no wider than `width` where more than one."""
    out: list[dict[str, Node]] = []
    for k in sorted(lib, key=lambda k: (lib[k].phase, k)):
        if not out or len(out[-1]) == TOGETHER or carried([*out[-1].values(), lib[k]]) > width:
            out.append({})
        out[-1][k] = lib[k]
    return out


def by_code(bars: DataFrame, sums: dict[str, Callable[[Column], Column]], names: list[str] | None = None) -> DataFrame:
    """factor, code and what `sums` makes of the formula's values (null where there is none) over a code's dates.

    A group of formulas is worked out and summed up before the next one, so no more stands on disk than the panel,
    the exchanges of one group and the sums, however many formulas there are.
    """
    spark, lib = bars.sparkSession, library()
    lib = {k: (lib | replicas())[k] for k in names} if names else lib
    folder = fresh(spark, "formulas")
    ready = written(prepared(bars).select("code", "date", *_NAMED, "ret"), f"{folder}/panel")
    parts, width = [], max(WIDTH, SMALL // (8 * max(ready.count(), 1)))
    for chosen in grouped(lib, width):
        wide = evaluate(ready, chosen)
        if (last := max(f.phase for f in chosen.values())) and last % 2 == 0:  # rows lie by date: their values go back to codes before they are summed up
            wide = wide.repartition("code")
        one = wide.groupBy("code").agg(*[F.struct(*[f(F.col(k)).alias(n) for n, f in sums.items()]).alias(k) for k in chosen])
        long = F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("x")) for k in chosen]))
        parts.append(written(one.select("code", long.alias("x")).select("x.factor", "code", "x.x.*"), f"{folder}/by_code-{len(parts)}"))
    remove(spark, f"{folder}/panel")
    return spark.read.schema(parts[0].schema).parquet(*[f"{folder}/by_code-{i}" for i in range(len(parts))])

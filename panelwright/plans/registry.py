"""Factors under names, with what they read and how far back, and computing, checking and saving many of them at once.

Tables are what is given; frames are named plans over tables and other frames, each built once however many
factors use it. A factor is an expression over one frame, a function of frames and tables, or SQL over them.
Expressions of one frame are computed side by side in one pass, and what several of them begin with is one column.
"""

from __future__ import annotations

import contextlib
import dataclasses
import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.elementwise import finite
from panelwright.plans import along
from panelwright.sources.folders import exists, file_system, fresh, remove, written


#: Expressions of one frame that each() works out together.
PART = 12


@dataclasses.dataclass(frozen=True)
class Table:
    """How a table's rows count in time. date: its column of dates.

    rule "rows": a value needs a number of rows before it, counted by (code, date) in `calendar` (a function of
    the inputs; the table's own rows where it is None). "events": it needs those of some calendar days.
    "published": it needs all that was known before. A table without a date is read whole. late: its rows come
    out after the date's close; announced: so many days before their date.
    """

    name: str
    date: str | None = "date"
    rule: str = "rows"
    calendar: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    late: bool = False
    announced: int = 0


@dataclasses.dataclass(frozen=True)
class Reach:
    """What a value needs before its own date: `rows` of the tables that count by rows (None: all of them), after
    which each section of that time needs `before` rows more, and `days` of events. ahead: days of events yet to
    come whose date is known already."""

    rows: int | None = 0
    before: int = 0
    days: int = 0
    ahead: int = 0

    def __or__(self, other: Reach) -> Reach:
        rows = None if self.rows is None or other.rows is None else max(self.rows, other.rows)
        return Reach(rows, max(self.before, other.before), max(self.days, other.days), max(self.ahead, other.ahead))

    def __add__(self, other: Reach) -> Reach:
        rows = None if self.rows is None or other.rows is None else self.rows + other.rows
        return Reach(rows, max(self.before, other.before), self.days + other.days, self.ahead + other.ahead)


@dataclasses.dataclass(frozen=True)
class Frame:
    """staged: each() writes it even where one frame alone reads it, so that its shuffles don't stand beside that one's."""

    name: str
    reads: tuple[str, ...]
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    reach: Reach = Reach()
    staged: bool = False


@dataclasses.dataclass(frozen=True)
class Factor:
    """reads: the tables or frames that it needs, each with the columns it uses. One of column, build and sql is given.

    steps: columns that `column` needs first, each level made of the ones before. A name may be used by several
    factors if it means the same in all.
    """

    name: str
    reads: dict[str, tuple[str, ...]]
    category: str = ""
    description: str = ""
    column: Callable[[], Column] | None = None
    build: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    sql: str | None = None
    steps: tuple[dict[str, Callable[[], Column]], ...] = ()
    reach: Reach = Reach(None)


class Inputs(Mapping):
    """Tables and frames by name; a frame is built when it is first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame], frames: Mapping[str, Frame]):
        self.tables, self.frames, self.made, self.written = tables, frames, {}, set()

    def stands(self, name: str) -> bool:
        """Whether the frame is a stored table, which can be read again for nothing but the reading."""
        return name in self.written

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name not in self.made:
            self.made[name] = self.frames[name].build(self)
        return self.made[name]

    def __iter__(self):
        return iter({**self.tables, **self.frames})

    def __len__(self) -> int:
        return len({**self.tables, **self.frames})


class Registry:
    def __init__(self, tables: Iterable[Table] = ()) -> None:
        self.factors: dict[str, Factor] = {}
        self.frames: dict[str, Frame] = {}
        self.tables = {t.name: t for t in tables}

    def add(self, factor: Factor) -> Factor:
        if factor.name in self.factors:
            raise ValueError(f"factor {factor.name} is registered twice")
        if sum(x is not None for x in (factor.column, factor.build, factor.sql)) != 1:
            raise ValueError(f"factor {factor.name} needs one of column, build and sql")
        if factor.column is not None and len(factor.reads) != 1:
            raise ValueError(f"factor {factor.name} is an expression and reads one table")
        self.factors[factor.name] = factor
        return factor

    def register(self, name: str, reads: dict[str, tuple[str, ...]], **about):
        """Decorator of a function of the inputs that gives code, date, value."""

        def put(f):
            self.add(Factor(name, reads, build=f, **about))
            return f

        return put

    def frame(self, name: str, *reads: str, reach: Reach = Reach(), staged: bool = False):
        """Decorator of a function of the inputs that gives a frame."""

        def put(f):
            if name in self.frames or name in self.tables:
                raise ValueError(f"frame {name} is registered twice")
            self.frames[name] = Frame(name, reads, f, reach, staged)
            return f

        return put

    def get(self, name: str) -> Factor:
        if name not in self.factors:
            raise KeyError(f"no factor {name}; there are {sorted(self.factors)}")
        return self.factors[name]

    def names(self, category: str | None = None) -> list[str]:
        return [n for n, f in self.factors.items() if category is None or f.category == category]

    def sources(self, name: str) -> set[str]:
        """The tables that a factor, frame or table comes from."""
        reads = self.factors[name].reads if name in self.factors else self.frames[name].reads if name in self.frames else None
        return {name} if reads is None else set().union(*map(self.sources, reads))

    def reach(self, name: str) -> Reach:
        """How far back a factor or frame needs its tables, through the frames between."""
        item = self.factors.get(name) or self.frames.get(name)
        if item is None:
            return Reach()
        below = Reach()
        for r in item.reads:
            below = below | self.reach(r)
        return item.reach + below

    def described(self, spark: SparkSession) -> DataFrame:
        """One row a factor: what is declared of it."""
        kind = lambda f: "column" if f.column else "build" if f.build else "sql"
        rows = [(f.name, f.category, f.description, kind(f), sorted(self.sources(f.name)), self.reach(f.name).rows, self.reach(f.name).days) for f in self.factors.values()]
        return spark.createDataFrame(rows, "factor string, category string, description string, kind string, reads array<string>, rows int, days int")

    def caveats(self, state: dict[str, Iterable[str]]) -> dict[str, list[str]]:
        """Factors that read a column of a table which only holds the current state: their past values know the present."""
        out = {}
        for f in self.factors.values():
            found = [f"{t}.{c}" for t, columns in f.reads.items() for c in columns if c in set(state.get(t, ()))]
            if found:
                out[f.name] = sorted(found)
        return out

    def compute(self, names: list[str], tables: Mapping[str, DataFrame], universe: DataFrame | None = None, first: str | None = None, last: str | None = None, store: bool = False) -> DataFrame:
        """factor, date, code, value of the named factors over tables, for dates from first to last.

        universe (code, or code and date) keeps its codes' rows. A SQL factor names its tables in braces, and
        {universe} a table of codes, all codes of its first table where none is given.

        With a range, tables that the registry declares are read only as far back as the factors reach: see
        pruned(). Factors that need all rows are computed from the whole past, beside the others. store: frames that
        several plans read are written to the shared folder once instead of being worked out in each.
        """
        for f in map(self.get, names):
            missing = self.sources(f.name) - set(tables)
            if missing:
                raise KeyError(f"factor {f.name} reads {sorted(missing)}")
        some = [[n for n in names if (self.reach(n).rows is None) == whole] for whole in (False, True)]
        d = None
        for group in filter(None, some):
            inputs = Inputs(self.pruned(group, tables, first, last), self.frames)
            if store:
                self._store(group, inputs)
            x = self._side_by_side(group, inputs, universe)
            d = x if d is None else d.unionByName(x)
        if universe is not None:
            d = d.join(universe, [c for c in ("date", "code") if c in universe.columns], "left_semi")
        if first is not None:
            d = d.where(F.col("date") >= F.lit(first).cast("date"))
        return d if last is None else d.where(F.col("date") <= F.lit(last).cast("date"))

    def stored(self, names: Iterable[str], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables that the named factors read, written to the shared folder once and read from there."""
        out: dict[str, DataFrame] = {}
        for name in sorted({s for n in names for s in self.sources(n)}):
            out[name] = _written(tables[name], name)
        return out

    @contextlib.contextmanager
    def kept(self, names: Iterable[str], tables: Mapping[str, DataFrame]):
        """The tables that the named factors read, written to the shared folder until the block ends."""
        out, folder, spark = {}, None, None
        try:
            for name in sorted({s for n in names for s in self.sources(n)}):
                spark = tables[name].sparkSession
                folder = folder or fresh(spark, "tables")
                out[name] = written(tables[name], f"{folder}/{name}")
            yield out
        finally:
            if folder:
                remove(spark, folder)

    def each(self, names: Iterable[str], tables: Mapping[str, DataFrame], then: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What `then` makes of factor, date, code, value, for some factors at a time: those of one frame, PART at most, or one alone.

        `then` gives far fewer rows than it gets, by factor. Each part is written before the next is worked out, and a
        frame that several read stands from the first of them to the last, so that disk holds the exchanges of one part.
        """
        plans = self._parts(names)
        inputs = Inputs({s: tables[s] for n in names for s in self.sources(n)}, self.frames)
        shared, last, born = self._shared([r for plan in plans for r in sorted({r for n in plan for r in self.get(n).reads})], True), {}, set()

        def needs(name: str, i: int) -> None:
            if name in shared:
                last[name] = i
            if name in self.frames and name not in born:
                born.update({name} & set(shared))
                for below in self.frames[name].reads:
                    needs(below, i)

        for i, plan in enumerate(plans):
            for r in {r for n in plan for r in self.get(n).reads}:
                needs(r, i)
        spark = next(iter(inputs.tables.values())).sparkSession
        folder, parts = fresh(spark, "parts"), []
        for i, plan in enumerate(plans):
            for name in shared:  # those below stand first
                if name not in inputs.made and name in self._below(plan):
                    inputs.made[name] = written(inputs[name], f"{folder}/{name}")
                    inputs.written.add(name)
            parts.append(written(then(self._side_by_side(plan, inputs, None)), f"{folder}/part-{i}"))
            for name in (n for n, at in last.items() if at == i):
                remove(spark, f"{folder}/{name}")
        return spark.read.schema(parts[0].schema).parquet(*[f"{folder}/part-{i}" for i in range(len(parts))])

    def _below(self, names: Iterable[str]) -> set[str]:
        """The frames that factors or frames come from."""
        reads = {r for n in names for r in (self.factors[n] if n in self.factors else self.frames[n]).reads if r in self.frames}
        return reads | (self._below(reads) if reads else set())

    def _parts(self, names: Iterable[str]) -> list[list[str]]:
        """The factors by the plans of each(); those that read the same frames stand together."""
        together: dict[str, list[str]] = {}
        out = []
        for f in map(self.get, names):
            if f.column is not None:
                together.setdefault(next(iter(f.reads)), []).append(f.name)
            else:
                out.append([f.name])
        out += [some[i : i + PART] for some in together.values() for i in range(0, len(some), PART)]
        return sorted(out, key=lambda plan: sorted(self._below(plan), reverse=True))

    def _store(self, names: list[str], inputs: Inputs) -> None:
        """Write the frames that more than one plan of these factors reads."""
        plans = [n for f in map(self.get, names) if f.column is None for n in f.reads] + sorted({next(iter(f.reads)) for f in map(self.get, names) if f.column is not None})
        for name in self._shared(plans):
            inputs.made[name] = _written(inputs[name], name)

    def _shared(self, plans: list[str], staged: bool = False) -> list[str]:
        """The frames that are read more than once if plans read these tables and frames, what a frame reads before itself; with staged=True also those that are staged."""
        readers: dict[str, int] = {}
        order: list[str] = []

        def walk(name: str) -> None:
            readers[name] = readers.get(name, 0) + 1
            if name in self.frames and readers[name] == 1:
                for below in self.frames[name].reads:
                    walk(below)
                order.append(name)

        for n in plans:
            walk(n)
        return [name for name in order if readers[name] > 1 or staged and self.frames[name].staged]

    def pruned(self, names: list[str], tables: Mapping[str, DataFrame], first: str | None, last: str | None) -> dict[str, DataFrame]:
        """tables without the rows that the named factors don't need for dates from first to last, as filters on their dates.

        How many dates some rows are differs by code, so the first date is looked up: one pass over code and
        date of the table that counts them, which brings one date to the driver. Codes that traded at all in
        the time that a section is made of count for it, so sections are as in the whole run.
        """
        out, found = {s: tables[s] for n in names for s in self.sources(n)}, {}
        day = lambda x: F.lit(x).cast("date")
        for name in set(out) & set(self.tables):
            t = self.tables[name]
            if t.date is None:
                continue
            readers = [n for n in names if name in self.sources(n)]
            reach = self.farthest(readers)
            if last is not None:
                until = F.date_add(day(last), reach.ahead) if t.rule == "events" else day(last)
                out[name] = out[name].where(F.col(t.date) <= until)
            if first is None or t.rule == "published" or reach.rows is None:
                continue
            since = min((self.since(s, tables, first, last, reach, found) for s in self.by_rows(readers)), default=None)
            if since is not None:
                out[name] = out[name].where(F.col(t.date) >= day(str(dt.date.fromisoformat(since) - dt.timedelta(reach.days if t.rule == "events" else 0))))
        return out

    def farthest(self, names: Iterable[str]) -> Reach:
        reach = Reach()
        for n in names:
            reach = reach | self.reach(n)
        return reach

    def by_rows(self, names: Iterable[str]) -> set[str]:
        """The tables behind the named factors that count by rows."""
        found = {s for n in names for s in self.sources(n) if s in self.tables}
        return {s for s in found if self.tables[s].rule == "rows" and self.tables[s].date is not None}

    def counted(self, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """(code, date) of the rows by which a table's reach is counted."""
        t = self.tables[name]
        return t.calendar(Inputs(tables, self.frames)) if t.calendar else tables[name].select("code", F.col(t.date).alias("date"))

    def since(self, name: str, tables: Mapping[str, DataFrame], first: str, last: str | None, reach: Reach, found: dict) -> str:
        """The first date that a reach by the rows of a table needs; kept in `found`."""
        key = (self.tables[name].calendar or name, reach.rows, reach.before)
        if key not in found:
            # many reaches are counted by one calendar, so its dates by code are worked out and written once
            calendar = ("dates", self.tables[name].calendar or name)
            if calendar not in found:
                found[calendar] = _written(dates_by_code(self.counted(name, tables)), "calendar")
            day = before_by_code(found[calendar], str(first), last, reach.rows)
            found[key] = before_by_code(found[calendar], day, last, reach.before) if reach.before else day
        return found[key]

    def _side_by_side(self, names: list[str], inputs: Inputs, universe: DataFrame | None) -> DataFrame:
        out, together = [], {}
        for f in map(self.get, names):
            if f.column is not None:
                together.setdefault(next(iter(f.reads)), []).append(f)
            elif f.build is not None:
                out.append(f.build(inputs).select(F.lit(f.name).alias("factor"), "date", "code", F.col("value").cast("double").alias("value")))
            else:
                frames = {t: inputs[t] for t in f.reads}
                codes = universe if universe is not None else inputs[next(iter(f.reads))].select("code").distinct()
                d = codes.sparkSession.sql(f.sql, **frames, **({"universe": codes} if "{universe}" in f.sql else {}))
                out.append(d.select(F.lit(f.name).alias("factor"), "date", "code", F.col("value").cast("double").alias("value")))
        for frame, some in together.items():
            p, ordered, steps = inputs[frame], False, []
            for level in range(max(len(f.steps) for f in some)):
                makers: dict[str, Callable[[], Column]] = {}
                for f in some:
                    for name, make in (f.steps[level] if level < len(f.steps) else {}).items():
                        if str(makers.setdefault(name, make)()) != str(make()):
                            raise ValueError(f"{name} means one thing in {f.name} and another elsewhere")
                steps.append(makers)
            # windows along codes are worked out together, for many rows at once
            steps.append({f"_f{i}": lambda f=f: f.column().cast("double") for i, f in enumerate(some)})
            for level, makers in enumerate(steps):
                p, ordered = along.with_columns(p, makers, " ".join(str(make()) for more in steps[level + 1 :] for make in more.values()), ordered)
            long = F.explode(F.array(*[F.struct(F.lit(f.name).alias("factor"), F.col(f"_f{i}").alias("value")) for i, f in enumerate(some)]))
            out.append(p.select("date", "code", long.alias("x")).select("x.factor", "date", "code", "x.value"))
        return _union(out)


def _written(df: DataFrame, name: str) -> DataFrame:
    return written(df, fresh(df.sparkSession, name))


def _union(some: list[DataFrame]) -> DataFrame:
    """Two and two together: the plan is as deep as the logarithm of their number."""
    while len(some) > 1:
        some = [a.unionByName(b) for a, b in zip(some[::2], some[1::2], strict=False)] + ([some[-1]] if len(some) % 2 else [])
    return some[0]


def rows_before(rows: DataFrame, first: str, last: str | None, n: int) -> str:
    """The earliest date, over the codes with rows from first to last, of the n-th row before a code's first one in that range; a code with fewer gives its first row."""
    return before_by_code(dates_by_code(rows), first, last, n)


def dates_by_code(rows: DataFrame) -> DataFrame:
    """code and its dates, the latest first; a code has at most as many as the calendar."""
    return rows.groupBy("code").agg(F.sort_array(F.collect_set("date"), asc=False).alias("dates"))


def before_by_code(calendar: DataFrame, first: str, last: str | None, n: int) -> str:
    """rows_before() from dates by code: one narrow pass."""
    start = F.lit(first).cast("date")
    known = F.col("dates") if last is None else F.filter("dates", lambda x: x <= F.lit(last).cast("date"))
    d = calendar.select(known.alias("dates")).select("dates", F.filter("dates", lambda x: x < start).alias("past")).where(F.size("dates") > F.size("past"))
    past = F.col("past")
    at = F.when((F.size(past) == 0) | F.lit(n == 0), start).otherwise(F.element_at(past, F.least(F.lit(n), F.size(past)).cast("int")))
    found = d.agg(F.min(at).alias("d")).first()["d"]
    return str(found) if found is not None else str(first)


def sanity(factors: DataFrame, valid: float = 0.05, constant: float = 0.5) -> DataFrame:
    """Per factor the share of finite values, the share of codes whose values do not vary, and ok: some value is finite, at least `valid` of them, and at most `constant` of the codes stand still."""
    x = finite(F.col("value"))
    by_code = factors.groupBy("factor", "code").agg(F.count("*").alias("n"), F.count(x).alias("k"), F.min(x).alias("a"), F.max(x).alias("b"))
    still = F.avg(F.when(F.col("k") > 0, (F.col("a") == F.col("b")).cast("double")))
    out = by_code.groupBy("factor").agg((F.sum("k") / F.sum("n")).alias("valid"), still.alias("constant"))
    return out.withColumn("ok", (F.col("valid") >= valid) & (F.col("valid") > 0) & (F.coalesce("constant", F.lit(1.0)) <= constant))


def save(factors: DataFrame, folder: str, mode: str = "replace") -> list[str]:
    """Write factor, date, code, value under `folder` by factor, those that pass sanity() alone; returns their names.

    mode "replace": the factors' partitions are replaced; "merge": rows of the same factor, date and code
    give way and others stay. New rows are written beside the folder first, so that what is read is never
    overwritten, and checked as they stand there. A job that dies before the last write leaves the old table as
    it was; that write replaces partition after partition, so one that dies in it may leave some factors new and
    others old, each of them whole.
    """
    spark = factors.sparkSession
    aside = fresh(spark, "factors")
    factors.write.partitionBy("factor").parquet(f"{aside}/new")
    new = spark.read.schema("date date, code string, value double, factor string").parquet(f"{aside}/new")
    good = [r["factor"] for r in sanity(new).where("ok").select("factor").collect()]
    new = new.where(F.col("factor").isin(good) & F.col("value").isNotNull())
    if mode == "merge" and exists(spark, folder):
        old = spark.read.schema(new.schema).parquet(folder).where(F.col("factor").isin(good))
        new = old.join(new, ["factor", "date", "code"], "left_anti").unionByName(new)
        # what is read here is replaced below, so the whole is written beside it first
        new.write.partitionBy("factor").parquet(f"{aside}/whole")
        new = spark.read.schema(new.schema).parquet(f"{aside}/whole")
    elif mode not in ("replace", "merge"):
        raise ValueError(f"no mode {mode}")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor").parquet(folder)
    fs, path = file_system(spark, aside)
    fs.delete(path, True)
    return sorted(good)

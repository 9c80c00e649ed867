"""Judging factors: rank IC, decay, quantile returns, metric tables, correlation, crowding.

A factor table is (date, code, factor, value); one job judges any number of factors, keyed by factor and date.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.elementwise import finite, safe_div
from panelwright.operators import panel, xs
from panelwright.plans import across, along
from panelwright.sources.folders import fresh, remove

KEY = ("factor", "date")


def with_forward(factors: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    """factors with fwd_h of the prices' own rows."""
    f = panel.forward_returns(prices.select("date", "code", "close"), horizons).drop("close")
    return factors.join(f, ["date", "code"])


def corr_if_varied(x: str, y: str) -> Column:
    """Correlation of an aggregation's rows, null where either does not vary."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, finite(F.corr(x, y)))


def rank_among(flag: Column, w) -> Column:
    """Competition rank among the rows where flag holds, in the order of window w: as many flags as are asked for share one sort."""
    one = flag.cast("int")
    upto, peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(flag, 1 + F.sum(one).over(upto) - F.sum(one).over(peers))


def daily_ic(joined: DataFrame, horizons: tuple[int, ...] = (1,), least: int = 30, by=KEY) -> DataFrame:
    """factor, date, h, n, ic (Pearson) and rank_ic (of competition ranks among rows with both values).

    A section is sorted once by value and once by each forward return; horizons whose rows differ take their
    ranks from the same order.
    """
    d = joined.select(*by, "code", "value", *[f"fwd_{h}" for h in horizons]).where("value is not null")
    there = {h: F.col(f"fwd_{h}").isNotNull() for h in horizons}
    w = xs.section(by)
    d = d.withColumns({f"_v{h}": rank_among(there[h], w.orderBy("value")) for h in horizons})
    for h in horizons:
        d = d.withColumn(f"_f{h}", F.when(there[h], F.rank().over(w.orderBy(F.col(f"fwd_{h}").asc_nulls_last()))))
    out = []
    for h in horizons:
        d = d.withColumn(f"_x{h}", F.when(there[h], F.col("value")))
        out += [F.count(f"fwd_{h}").alias(f"n_{h}"), corr_if_varied(f"_x{h}", f"fwd_{h}").alias(f"ic_{h}"), corr_if_varied(f"_v{h}", f"_f{h}").alias(f"rank_ic_{h}")]
    wide = d.groupBy(*by).agg(*out)
    long = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"n_{h}").alias("n"), F.col(f"ic_{h}").alias("ic"), F.col(f"rank_ic_{h}").alias("rank_ic")) for h in horizons]))
    return wide.select(*by, long.alias("x")).select(*by, "x.*").where(F.col("n") >= least)


def ic_summary(ic: DataFrame, by=("factor", "h")) -> DataFrame:
    m, s = F.avg("rank_ic"), F.stddev_samp("rank_ic")
    return ic.groupBy(*by).agg(F.count("rank_ic").alias("days"), m.alias("mean"), s.alias("sd"), safe_div(m, s).alias("icir"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("win"), F.avg("n").alias("avg_n"))


def half_life(summary: DataFrame, by: str = "factor") -> DataFrame:
    """Horizon at which |mean IC| falls to half of its peak after it, by linear interpolation; null if it does not."""
    w = Window.partitionBy(by)
    d = summary.withColumn("a", F.abs("mean")).withColumn("peak", F.max("a").over(w))
    d = d.withColumn("at", F.min(F.when(F.col("a") == F.col("peak"), F.col("h"))).over(w)).where(F.col("h") >= F.col("at"))
    o = Window.partitionBy(by).orderBy("h")
    d = d.withColumns({"a0": F.lag("a").over(o), "h0": F.lag("h").over(o)})
    cross = (F.col("a") <= F.col("peak") / 2) & (F.col("a0") > F.col("peak") / 2)
    at = F.col("h0") + (F.col("a0") - F.col("peak") / 2) / (F.col("a0") - F.col("a")) * (F.col("h") - F.col("h0"))
    return d.groupBy(by).agg(F.max("peak").alias("peak"), F.min(F.when(cross, at)).alias("half_life"))


def quantile_returns(joined: DataFrame, h: int, n: int, least: int = 30, by=KEY) -> DataFrame:
    """Mean forward return of each ntile on every h-th date."""
    dates = panel.every_kth(joined.select("date"), h)
    d = joined.join(F.broadcast(dates), "date").where(F.col("value").isNotNull() & F.col(f"fwd_{h}").isNotNull())
    d = d.withColumns({"q": xs.ntile("value", n, by), "n": F.count("*").over(Window.partitionBy(*by))}).where(F.col("n") >= least)
    return d.groupBy(*by, "q").agg(F.avg(f"fwd_{h}").alias("ret"), F.count("*").alias("n"))


def long_short(buckets: DataFrame, n: int, per_year: float) -> DataFrame:
    """Top less bottom bucket by factor: mean, t, annualised, win rate, worst drawdown of the compounded series."""
    d = buckets.groupBy("factor", "date").agg(F.max(F.when(F.col("q") == n, F.col("ret"))).alias("a"), F.max(F.when(F.col("q") == 1, F.col("ret"))).alias("b")).withColumn("ls", F.col("a") - F.col("b")).where("ls is not null")
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("nav", F.sum("ls").over(w)).withColumn("dd", F.col("nav") - F.max("nav").over(w))
    m, s = F.avg("ls"), F.stddev_samp("ls")
    return d.groupBy("factor").agg(F.count("*").alias("n"), m.alias("mean"), safe_div(m, s / F.sqrt(F.count("*"))).alias("t"), (m * per_year).alias("annual"), F.avg((F.col("ls") > 0).cast("double")).alias("win"), F.min("dd").alias("drawdown"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Correlation of bucket number and mean return by factor."""
    m = buckets.groupBy("factor", "q").agg(F.avg("ret").alias("ret"))
    m = m.withColumn("r", F.rank().over(Window.partitionBy("factor").orderBy("ret")))
    return m.groupBy("factor").agg(F.corr("q", "r").alias("monotone"))


def autocorrelation(factors: DataFrame, k: int) -> DataFrame:
    """Correlation of today's ranks with the code's rank k of its rows before, by factor and date."""
    d = factors.where("value is not null").withColumn("r", xs.rank("value", KEY))
    d = d.withColumn("r0", F.lag("r", k).over(Window.partitionBy("factor", "code").orderBy("date"))).where("r0 is not null")
    return d.groupBy(*KEY).agg(F.count("*").alias("n"), corr_if_varied("r", "r0").alias("rho"))


def bucket_turnover(factors: DataFrame, n: int, bucket: int) -> DataFrame:
    """Share of the bucket's codes that were not in it on the factor's date before."""
    d = factors.where("value is not null").withColumn("q", xs.ntile("value", n, KEY)).where(F.col("q") == bucket)
    seq = factors.select("factor", "date").distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    d = d.join(seq, ["factor", "date"]).select("factor", "date", "i", "code")
    before = d.select("factor", (F.col("i") + 1).alias("i"), "code", F.lit(1).alias("was"))
    return d.where("i > 1").join(before, ["factor", "i", "code"], "left").groupBy("factor", "date").agg((1 - F.sum(F.coalesce("was", F.lit(0))) / F.count("*")).alias("turnover"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Competition ranks down each column."""
    return np.stack([np.searchsorted(np.sort(c), c, "left") + 1.0 for c in x.T], 1) if x.size else x


def section_correlations(names: list[str], x: np.ndarray, least: int) -> list[tuple[str, str, int, float | None]]:
    """(a, b, n, rho) of every two columns a < b of a section's values (null: NaN); ranks are those of the rows that both have.

    Columns with the same rows are ranked once and correlated by one product of matrices.
    """
    there = np.isfinite(x)
    masks, of = np.unique(there, axis=1, return_inverse=True)
    out = []
    for g in range(masks.shape[1]):
        for h in range(g, masks.shape[1]):
            rows = masks[:, g] & masks[:, h]
            n = int(rows.sum())
            if n < least:
                continue
            i, j = np.flatnonzero(of == g), np.flatnonzero(of == h)
            both = [_ranks(x[np.ix_(rows, k)]) for k in (i, j)]
            both = [r - r.mean(0) for r in both]
            size = [np.sqrt((r * r).sum(0)) for r in both]
            with np.errstate(invalid="ignore", divide="ignore"):
                rho = (both[0].T @ both[1]) / np.outer(*size)
            for k, m in ((k, m) for k in range(len(i)) for m in range(len(j)) if g != h or k < m):
                a, b = sorted((names[i[k]], names[j[m]]))
                out.append((a, b, n, float(rho[k, m]) if size[0][k] > 0 and size[1][m] > 0 else None))
    return out


def daily_pairs(factors: DataFrame, least: int = 30) -> DataFrame:
    """date, a, b, n, rho: rank correlation of every two factors a < b on each date.

    A date's section, codes by factors, is one group: the table is shuffled once, not once a pair. Rows that
    repeat a factor and code on a date count as their greatest value.
    """

    def one(pdf):
        import pandas as pd

        wide = pdf.pivot_table(index="code", columns="factor", values="value", aggfunc="max")
        rows = section_correlations(list(wide.columns), wide.to_numpy(float), least)
        return pd.DataFrame({"date": pd.Series([pdf["date"].iloc[0]] * len(rows), dtype=object), "a": pd.Series([r[0] for r in rows], dtype=object), "b": pd.Series([r[1] for r in rows], dtype=object), "n": pd.array([r[2] for r in rows], dtype="Int64"), "rho": pd.array([r[3] for r in rows], dtype="Float64")})

    return factors.where("value is not null").select("date", "factor", "code", "value").groupBy("date").applyInPandas(one, "date date, a string, b string, n long, rho double")


def pairwise(factors: DataFrame, least: int = 30) -> DataFrame:
    """Mean rank correlation of every two factors a < b over dates, and the dates that have one."""
    return daily_pairs(factors, least).groupBy("a", "b").agg(F.avg("rho").alias("rho"), F.count("rho").alias("days"))


def clusters(pairs: DataFrame, factors: DataFrame, bound: float = 0.7) -> DataFrame:
    """factor, cluster (its least factor's name), size, medoid: factors linked by pairs (a, b, rho) of at least `bound` in size form a cluster; its medoid has the highest mean |rho| to its others, ties by name.

    The least name spreads over the links round by round until nothing changes; the table has a row a
    factor. Each round is written to the shared folder, where it ends the lineage, and the one before deleted.
    """
    spark = pairs.sparkSession
    folder = fresh(spark, "clusters")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = pairs.where(F.abs("rho") >= bound).select("a", "b")
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label, turn = written(factors.select("factor").distinct().withColumn("cluster", F.col("factor")), "0"), 0
    while True:
        near = links.join(label.select(F.col("factor").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("factor")).agg(F.min("cluster").alias("_near"))
        spread = label.join(near, "factor", "left").select("factor", F.least("cluster", F.coalesce("_near", "cluster")).alias("cluster"), (F.col("_near") < F.col("cluster")).alias("_moved"))
        spread, turn = written(spread, str(turn + 1)), turn + 1
        remove(spark, f"{folder}/{turn - 1}")
        label = spread.select("factor", "cluster")
        if spread.where("_moved").isEmpty():
            break
    both = pairs.select("a", "b", F.abs("rho").alias("r"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    inside = both.join(label.select(F.col("factor").alias("a"), "cluster"), "a").join(label.select(F.col("factor").alias("b"), F.col("cluster").alias("_c")), "b").where("cluster = _c")
    mean = inside.groupBy(F.col("a").alias("factor")).agg(F.avg("r").alias("_r"))
    w = Window.partitionBy("cluster")
    d = label.join(mean, "factor", "left").withColumn("_r", F.round(F.coalesce("_r", F.lit(0.0)), 9))
    d = d.withColumns({"size": F.count("*").over(w), "medoid": F.first("factor").over(w.orderBy(F.desc("_r"), "factor"))})
    return d.select("factor", "cluster", "size", "medoid")


def daily_metrics(panel_: DataFrame, names: list[str], horizons: tuple[int, ...] = (1, 5, 10, 20), lags: tuple[int, ...] = (1, 5, 20), least: int = 30, ends: tuple[int, int] | None = None, share: float = 0.5) -> DataFrame:
    """A row a factor and date of a panel (date, code, close and a column a factor): what a daily check needs, in one job.

    rows and n (values); coverage n / rows and degraded (coverage below `share`); sd, q01, q50, q99; for each
    horizon h in rows ic_h and rank_ic_h over rows with a value and a forward return (null under `least`);
    ret_h_1 to ret_h_5 of the first and last horizon (or `ends`), quintiles of those rows; for each lag
    auto_lag, the correlation of ranks with the code's ranks that many rows before; turnover_1 and
    turnover_5, the share of the bottom and top fifth's codes that were not there on the date before.

    Prices are read once and nothing is joined but the dates' numbers. Rows are dealt by date, where a section
    gives its numbers and each row's ranks and fifths, and once more by code, where those meet the ranks before
    them; what is left is a few sums a factor and date. A section is sorted once a column, in numpy.
    """
    first, last = ends or (horizons[0], horizons[-1])
    ends = tuple(dict.fromkeys((first, last)))
    p = panel.forward_returns(panel_, horizons)
    dates = panel_.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    p = p.join(F.broadcast(dates), "date").select("date", "code", "_i", *[F.col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(names)], *[F.col(f"fwd_{h}").cast("double").alias(f"_f{h}") for h in horizons])
    doubles = ["coverage", "sd", "q01", "q50", "q99", *[f"{x}_{h}" for h in horizons for x in ("ic", "rank_ic")], *[f"ret_{h}_{q}" for h in ends for q in range(1, 6)]]
    numbers = "struct<rows: long, n: long, " + ", ".join(f"{x}: double" for x in doubles) + ">"
    each = lambda *c: ", ".join(f"{x}{i} double" for i in range(len(names)) for x in c)
    d = across.sectioned(p, lambda t: section_metrics(t, len(names), horizons, ends, least, ["rows", "n", *doubles]), f"date date, code string, _i int, {each('_r', '_q')}, _factor int, _m {numbers}", "code")
    sums = [f"{s}_{k}" for k in lags for s in BEFORE]
    kept = [f"{x}_{q}" for q in (1, 5) for x in ("there", "stayed")]
    d = d.repartition("code").sortWithinPartitions("code", "date")
    d = d.mapInArrow(lambda batches: before_metrics(batches, len(names), lags), f"date date, _i int, _factor int, _m {numbers}, {', '.join(f'{x} double' for x in sums + kept)}")
    d = d.groupBy("date", "_factor").agg(F.first("_m", ignorenulls=True).alias("_m"), F.max("_i").alias("_i"), *[(F.min if x[:3] == "min" else F.max if x[:3] == "max" else F.sum)(x).alias(x) for x in sums + kept])

    def auto(k: int) -> Column:
        n, r, before, rr, bb, rb = (F.col(f"{x}_{k}") for x in BEFORE[:6])
        varies = (F.col(f"min_r_{k}") < F.col(f"max_r_{k}")) & (F.col(f"min_b_{k}") < F.col(f"max_b_{k}"))
        return F.when(varies, finite((rb - r * before / n) / F.sqrt((rr - r * r / n) * (bb - before * before / n))))

    gone = lambda q: F.when((F.col("_i") > 1) & (F.col(f"there_{q}") > 0), 1 - F.col(f"stayed_{q}") / F.col(f"there_{q}"))
    m = lambda x: F.col(f"_m.{x}").alias(x)
    out = [m("rows"), m("n"), m("coverage"), (F.col("_m.coverage") < share).alias("degraded"), *[m(x) for x in doubles[1:]]]
    return d.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("_factor")).alias("factor"), "date", *out, *[auto(k).alias(f"auto_{k}") for k in lags], gone(1).alias("turnover_1"), gone(5).alias("turnover_5"))


#: What is summed of ranks and the ranks before them, for each lag.
BEFORE = ("n", "r", "b", "rr", "bb", "rb", "min_r", "max_r", "min_b", "max_b")


def _corr(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation, null where either does not vary."""
    if not (len(x) and x.min() < x.max() and y.min() < y.max()):
        return None
    x, y = x - x.mean(), y - y.mean()
    c = float(x @ y / np.sqrt((x @ x) * (y @ y)))
    return c if np.isfinite(c) else None


def _fifths(places: np.ndarray) -> np.ndarray:
    """The fifth of each of n rows, whose places in order (from 0) are given; the first fifths are larger by one where n is no multiple of 5."""
    size, more = divmod(len(places), 5)
    large = more * (size + 1)
    return np.where(places < large, places // (size + 1), more + (places - large) // max(size, 1)) + 1.0


def section_metrics(t, factors: int, horizons, ends, least: int, numbers: list[str]):
    """A date's rows (by code) with their rank and fifth by each factor, and a row without a code for each factor with its numbers."""
    import pyarrow as pa

    size = t.num_rows
    fwd = {h: across.column(t, f"_f{h}") for h in horizons}
    rows, ranks = [], {}
    for i in range(factors):
        x, some = across.column(t, f"_x{i}")
        r, _ = across.rank(x, some)
        order = np.flatnonzero(some)[np.argsort(x[some], kind="stable")]  # equal values by code
        place = np.zeros(size, np.int64)
        place[order] = np.arange(len(order))
        q = np.zeros(size)
        q[some] = _fifths(place[some])
        ranks |= {f"_r{i}": pa.array(r, mask=~some), f"_q{i}": pa.array(q, mask=~some)}
        v, n = x[order], len(order)
        m = {"rows": size, "n": n, "coverage": n / size, "sd": float(np.std(v, ddof=1)) if n > 1 else None}
        for a, share in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99)):
            at = share * (n - 1)
            k = int(np.floor(at))
            m[a] = float(v[k] + (v[int(np.ceil(at))] - v[k]) * (at - k)) if n else None
        for h in horizons:
            y, has = fwd[h]
            both = some & has
            enough = int(both.sum()) >= least
            m[f"ic_{h}"] = _corr(x[both], y[both]) if enough else None
            m[f"rank_ic_{h}"] = _corr(across.rank(x, both)[0][both], across.rank(y, both)[0][both]) if enough else None
            if h in ends:
                chosen = order[has[order]]
                fifth_ = _fifths(np.arange(len(chosen)))
                for g in range(1, 6):
                    y_g = y[chosen[fifth_ == g]]
                    m[f"ret_{h}_{g}"] = float(y_g.mean()) if len(y_g) else None
        rows.append(m)
    more = pa.nulls(factors, pa.float64())
    whole = {"date": t["date"].combine_chunks(), "code": t["code"].combine_chunks(), "_i": t["_i"].combine_chunks(), **ranks, "_factor": pa.nulls(size, pa.int32())}
    kinds = pa.struct([(k, pa.int64() if k in ("rows", "n") else pa.float64()) for k in numbers])
    extra = {"date": whole["date"].take(pa.array([0] * factors)), "code": pa.nulls(factors, pa.string()), "_i": whole["_i"].take(pa.array([0] * factors)), **{c: more for c in ranks}, "_factor": pa.array(range(factors), pa.int32()), "_m": pa.array(rows, kinds)}
    return pa.concat_tables([pa.table({**whole, "_m": pa.nulls(size, kinds)}), pa.table(extra)])


def before_metrics(batches, factors: int, lags):
    """From rows by code in date order: sums of the ranks and those `lags` values before, and how many of the outer fifths were there on the date before, by date and factor. Rows without a code pass."""
    import pyarrow as pa
    import pyarrow.compute as pc

    passed = []
    names = [f"{s}_{k}" for k in lags for s in BEFORE] + [f"{x}_{q}" for q in (1, 5) for x in ("there", "stayed")]

    def with_code():
        for b in batches:
            own = pc.is_valid(b["_m"])
            if own.true_count:
                passed.append(b.filter(own))
                b = b.filter(pc.invert(own))
            if b.num_rows:
                yield b

    def done(t, place):
        code, i = np.cumsum(place == 0), t["_i"].to_numpy()
        dates, day = np.unique(i, return_inverse=True)
        width = len(dates)
        first = np.zeros(width, np.int64)
        first[day] = np.arange(len(day))
        out = []
        for f in range(factors):
            (r, some), (q, _) = across.column(t, f"_r{f}"), across.column(t, f"_q{f}")
            at, sums = np.flatnonzero(some), {}
            for k in lags:
                now, then = at[k:], at[: max(len(at) - k, 0)]
                same = code[now] == code[then]
                now, x, y = now[same], r[now[same]], r[then[same]]
                on = day[now]
                total = lambda w=None, on=on: np.bincount(on, w, width).astype(float)
                n = total()
                sums |= dict(zip([f"{s}_{k}" for s in BEFORE[:6]], [n, total(x), total(y), total(x * x), total(y * y), total(x * y)], strict=True))
                for v, name in ((x, "r"), (y, "b")):
                    low, high = np.full(width, np.inf), np.full(width, -np.inf)
                    np.minimum.at(low, on, v)
                    np.maximum.at(high, on, v)
                    sums |= {f"min_{name}_{k}": low, f"max_{name}_{k}": high}
            was = np.zeros(len(q))
            was[1:] = np.where((place[1:] > 0) & (i[:-1] == i[1:] - 1), q[:-1], 0)
            for g in (1, 5):
                sums |= {f"there_{g}": np.bincount(day, q == g, width), f"stayed_{g}": np.bincount(day, (q == g) & (was == g), width)}
            out.append(pa.table({"date": t["date"].take(pa.array(first)), "_i": pa.array(dates, pa.int32()), "_factor": pa.array(np.full(width, f), pa.int32()), "_m": pa.nulls(width, t["_m"].type), **{c: pa.array(np.asarray(sums[c], float)) for c in names}}))
        return pa.concat_tables(out)

    yield from along.by_code(with_code(), done, 1 << 17)
    for b in passed:
        t = pa.Table.from_batches([b])
        yield from pa.table({**{c: t[c] for c in ("date", "_i", "_factor", "_m")}, **{c: pa.nulls(t.num_rows, pa.float64()) for c in names}}).combine_chunks().to_batches()


def crowding(members: DataFrame, returns: DataFrame, window: int = 60, most: int = 100, before: int = 40) -> DataFrame:
    """Per factor and date of members (factor, date, code, side, score, bp, turnover; side 1 long, -1 short): how crowded the long side is.

    spread: ln of the long side's median bp over the short side's; corr: mean pairwise correlation of the
    returns of the `most` highest scores of the long side over the last `window` rows, of names with all of
    them; turnover: the long side's median. Each gets a z against the factor's dates up to its own (`before`
    at least), and crowding is the mean of those z, where two or more are there.

    Pairs are never formed: with returns standardised over the window, the sum over pairs is the square of
    their sum less the sum of their squares, position by position.
    """
    key = ("factor", "date")
    long, short = F.col("side") == 1, F.col("side") == -1
    med = lambda side, x: F.percentile(F.when(side, F.col(x)), F.lit(0.5))
    sides = members.groupBy(*key).agg(F.ln(safe_div(med(long, "bp"), med(short, "bp"))).alias("spread"), med(long, "turnover").alias("turnover"))
    past = F.collect_list("ret").over(Window.partitionBy("code").orderBy("date").rowsBetween(1 - window, 0))
    last = returns.select("date", "code", past.alias("_l")).where(F.size("_l") == window)
    top = members.where(long).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "code"))).where(F.col("_k") <= most)
    d = top.join(last, ["date", "code"])
    mean = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / window
    d = d.withColumn("_m", mean).withColumn("_s", F.sqrt(F.aggregate("_l", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / window)).where("_s > 0")
    z = d.select(*key, "code", F.posexplode(F.transform("_l", lambda x: (x - F.col("_m")) / F.col("_s"))).alias("i", "z"))
    at = z.groupBy(*key, "i").agg(F.count("*").alias("n"), (F.sum("z") * F.sum("z") - F.sum(F.col("z") * F.col("z"))).alias("p"))
    pairs = at.groupBy(*key).agg(F.when(F.max("n") > 1, F.sum("p") / (F.count("*") * F.max("n") * (F.max("n") - 1))).alias("corr"))
    d = sides.join(pairs, list(key), "left")
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    parts = ("spread", "corr", "turnover")
    d = d.withColumns({f"_z{x}": F.when((F.count(x).over(w) >= before) & (F.min(x).over(w) < F.max(x).over(w)), (F.col(x) - F.avg(x).over(w)) / F.stddev_samp(x).over(w)) for x in parts})
    zs = F.array(*[F.col(f"_z{x}") for x in parts])
    there = F.filter(zs, lambda v: v.isNotNull())
    return d.select(*key, *parts, F.when(F.size(there) >= 2, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there)).alias("crowding"))


def walk_forward(factors: DataFrame, prices: DataFrame, h: int, look: int = 52, least: int = 20, section: int = 30) -> DataFrame:
    """date, code, score: z-scores of the factors, each with the sign and the mean over deviation of its rank ICs of the last `look` dates (at least `least`) whose forward returns of h rows had ended by then."""
    i = daily_ic(with_forward(factors, prices, (h,)), (h,), section).select("factor", "date", "rank_ic")
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - look - h, -h)
    i = i.withColumns({"n": F.count("rank_ic").over(w), "m": F.avg("rank_ic").over(w), "sd": F.stddev_samp("rank_ic").over(w)}).where((F.col("n") >= least) & (F.col("sd") > 0))
    weights = i.select("factor", "date", F.signum("m").alias("direction"), F.abs(F.col("m") / F.col("sd")).alias("weight"))
    z = factors.withColumn("z", xs.zscore("value", KEY)).where("z is not null")
    return z.join(weights, ["factor", "date"]).groupBy("date", "code").agg((F.sum(F.col("z") * F.col("direction") * F.col("weight")) / F.sum("weight")).alias("score"))


def rolling_metrics(ic: DataFrame, window: int, least: int = 10) -> DataFrame:
    """Rolling mean, win rate and t of the rank IC of each factor and horizon."""
    w = Window.partitionBy("factor", "h").orderBy("date").rowsBetween(1 - window, 0)
    n, m, s = F.count("rank_ic").over(w), F.avg("rank_ic").over(w), F.stddev_samp("rank_ic").over(w)
    ok = n >= least
    return ic.select("factor", "h", "date", F.when(ok, m).alias("mean"), F.when(ok, F.avg((F.col("rank_ic") > 0).cast("double")).over(w)).alias("win"), F.when(ok & (s > 0), m / (s / F.sqrt(n))).alias("t"))


def newey_west(series: DataFrame, x: str, lags: int, by: str, order: str = "date") -> DataFrame:
    """Mean of x and its t with Bartlett weights over `lags` autocovariances."""
    w = Window.partitionBy(by).orderBy(order)
    d = series.where(F.col(x).isNotNull()).withColumn("_e", F.col(x) - F.avg(x).over(Window.partitionBy(by)))
    d = d.withColumns({f"_l{i}": F.lag("_e", i).over(w) for i in range(1, lags + 1)})
    v = F.sum(F.col("_e") * F.col("_e")) / F.count("*")
    for i in range(1, lags + 1):
        v = v + 2 * (1 - i / (lags + 1)) * F.sum(F.col("_e") * F.col(f"_l{i}")) / F.count("*")
    return d.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.when(v > 0, F.avg(x) / F.sqrt(v / F.count("*"))).alias("t"))


def discoveries(tests: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q of two-sided p from t (normal tail by the Abramowitz-Stegun 7.1.26 polynomial), and a flag for |t| > 3. One row a test, ordered in one window."""
    x = F.abs("t") / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    d = tests.withColumn("p", poly * F.exp(-x * x))
    w = Window.orderBy("p", "factor")
    d = d.withColumn("raw", F.col("p") * F.count("*").over(Window.partitionBy()) / F.row_number().over(w))
    q = F.min("raw").over(w.rowsBetween(0, Window.unboundedFollowing))
    return d.withColumns({"q": F.least(F.lit(1.0), q), "strong": F.abs("t") > 3}).drop("raw")


def coverage(factors: DataFrame, dates: DataFrame) -> DataFrame:
    """Per factor its last date, codes on the last two dates, dates behind the calendar, and whether it is in order."""
    n = factors.where("value is not null").groupBy("factor", "date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("factor").orderBy(F.desc("date"))
    n = n.withColumns({"k": F.row_number().over(w), "before": F.lead("n").over(w)}).where("k = 1")
    cal = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)
    return n.join(F.broadcast(cal), "date").select("factor", "date", "n", "before", F.col("i").alias("behind"), ((F.col("i") <= 1) & (F.col("n") >= 0.9 * F.coalesce("before", "n"))).alias("ok"))


def pair_corr_mean(returns: DataFrame, x: str, by: str, key: str = "code", order: str = "date") -> DataFrame:
    """Mean correlation over all pairs of codes in a group that share all dates, without making pairs: the sum over dates of ((sum z)^2 - sum z^2), z standardised by code."""
    w = Window.partitionBy(by, key)
    d = returns.where(F.col(x).isNotNull()).withColumns({"_n": F.count("*").over(w), "_s": F.stddev_pop(x).over(w), "_m": F.avg(x).over(w)})
    d = d.withColumn("_all", F.max("_n").over(Window.partitionBy(by))).where((F.col("_n") == F.col("_all")) & (F.col("_s") > 0))
    d = d.withColumn("_z", (F.col(x) - F.col("_m")) / F.col("_s"))
    s = d.groupBy(by, order).agg((F.sum("_z") * F.sum("_z") - F.sum(F.col("_z") * F.col("_z"))).alias("p"), F.count("*").alias("k"))
    return s.groupBy(by).agg(F.max("k").alias("codes"), safe_div(F.sum("p"), F.count("*") * F.max("k") * (F.max("k") - 1)).alias("rho"))

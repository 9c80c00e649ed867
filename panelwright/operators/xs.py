"""Cross-section operators: columns over the codes of one date. Nulls take no part and stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.elementwise import safe_div

BY = ("date",)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def section(by=BY) -> WindowSpec:
    return Window.partitionBy(*by)


def rank_pct(x, by=BY) -> Column:
    """Average rank divided by the number of values."""
    x = _col(x)
    # One ordering serves rank and ties: nulls stand last, and peers are a frame from the current value to itself.
    w = section(by).orderBy(x.asc_nulls_last())
    same = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + (same - 1) / 2) / F.count(x).over(section(by)))


def rank(x, by=BY, desc: bool = False) -> Column:
    """Competition rank; nulls have none."""
    x = _col(x)
    return F.when(x.isNotNull(), F.rank().over(section(by).orderBy(x.desc_nulls_last() if desc else x.asc_nulls_last())))


def rank_product(x, y, by=BY) -> Column:
    """Product of two competition ranks as a long: from ranks of 46,341 on it passes the int range."""
    return rank(x, by).cast("long") * rank(y, by).cast("long")


def scale(x, a: float = 1.0, by=BY) -> Column:
    return safe_div(_col(x) * a, F.sum(F.abs(_col(x))).over(section(by)))


def zscore(x, by=BY, flat: str = "null") -> Column:
    """(x - mean) / sample deviation; without deviation null, or 0 with flat="demean"."""
    x = _col(x)
    w = section(by)
    centred = x - F.avg(x).over(w)
    varies = F.min(x).over(w) < F.max(x).over(w)
    return F.when(varies, centred / F.stddev_samp(x).over(w)).otherwise(centred if flat == "demean" else F.lit(None))


def winsorize_mad(df: DataFrame, x: str, out: str, n: float = 3.0, by=BY) -> DataFrame:
    """Clip to median +- n * 1.4826 * MAD; a MAD of 0 leaves values as they are."""
    w = section(by)
    d = df.withColumn("_m", F.percentile(x, F.lit(0.5)).over(w))
    d = d.withColumn("_mad", F.percentile(F.abs(F.col(x) - F.col("_m")), F.lit(0.5)).over(w) * 1.4826)
    clipped = F.least(F.greatest(F.col(x), F.col("_m") - n * F.col("_mad")), F.col("_m") + n * F.col("_mad"))
    return d.withColumn(out, F.when(F.col(x).isNotNull(), F.when(F.col("_mad") > 0, clipped).otherwise(F.col(x)))).drop("_m", "_mad")


def qcut(df: DataFrame, x: str, out: str, n: int, by=BY) -> DataFrame:
    """Bucket 0.. by interpolated quantiles, edges that repeat counted once; intervals are closed above, the first also below."""
    inner = F.array(*[F.lit(i / n) for i in range(n + 1)])
    d = df.withColumn("_e", F.array_distinct(F.percentile(F.col(x), inner).over(section(by))))
    bucket = F.greatest(F.size(F.filter("_e", lambda e: e < F.col(x))) - 1, F.lit(0))
    return d.withColumn(out, F.when(F.col(x).isNotNull() & (F.size("_e") > 1), bucket)).drop("_e")


def ntile(x, n: int, by=BY, tie: str = "code") -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.ntile(n).over(Window.partitionBy(*by, x.isNotNull().cast("int")).orderBy(x, tie)))


def percent_rank(x, by=BY) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.percent_rank().over(Window.partitionBy(*by, x.isNotNull().cast("int")).orderBy(x)))


def neutralize(df: DataFrame, y: str, size: str | None, group: str | None, out: str, least: int = 30, by: str = "date") -> DataFrame:
    """Residual of y on group dummies and ln(size), by section; sections of fewer than `least` usable rows give null.

    Regressing on dummies and x is regressing y less its group mean on x less its group mean. With size
    alone there is no intercept.
    """
    usable = F.col(y).isNotNull()
    lx = None
    if size:
        usable = usable & (F.col(size) > 0)
        lx = F.when(usable, F.ln(F.col(size)))
    if group:
        usable = usable & F.col(group).isNotNull()
    ok = F.coalesce(usable, F.lit(False))
    g = Window.partitionBy(by, *([group] if group else []), "_ok")
    d = df.withColumn("_ok", ok).withColumn("_y", F.when(ok, F.col(y)))
    d = d.withColumn("_x", F.when(F.col("_ok"), F.ln(F.col(size))) if lx is not None else F.lit(None).cast("double"))
    if group:
        d = d.withColumns({"_y": F.col("_y") - F.avg("_y").over(g), "_x": F.col("_x") - F.avg("_x").over(g)})
    w = Window.partitionBy(by)
    if lx is not None:
        b = safe_div(F.sum(F.col("_x") * F.col("_y")).over(w), F.sum(F.col("_x") * F.col("_x")).over(w))
        d = d.withColumn("_r", F.col("_y") - F.coalesce(b, F.lit(0.0)) * F.col("_x"))
    else:
        d = d.withColumn("_r", F.col("_y"))
    return d.withColumn(out, F.when(F.count("_y").over(w) >= least, F.col("_r"))).drop("_ok", "_y", "_x", "_r")


def residual(y, x, by=BY, least: int = 3) -> Column:
    """Residual of y on an intercept and x, by section."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    w = section(by)
    b = safe_div(F.covar_samp(x, y).over(w), F.var_samp(x).over(w))
    return F.when(F.count(x).over(w) >= least, y - F.avg(y).over(w) - F.coalesce(b, F.lit(0.0)) * (x - F.avg(x).over(w)))


def residual_many(df: DataFrame, y: str, styles: list[str], out: str, least: int = 100, by: str = "date") -> DataFrame:
    """Residual of y on an intercept and several styles, by section.

    A section's cross products (k by k, summed by Spark with partial aggregation) come as one row, are
    solved in numpy, and go back to the section's rows with its coefficients.
    """
    names = [*styles, y]
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    usable = df.where(ok)
    k = len(names)
    cells = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = usable.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], *cells).where(F.col("n") >= least)

    def solve(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.array([getattr(r, f"s{i}") for i in range(k)]) / r.n
                c = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        c[i, j] = c[j, i] = getattr(r, f"p{i}_{j}") / r.n - m[i] * m[j]
                b = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
                rows.append((getattr(r, by), b.tolist(), float(m[-1] - b @ m[:-1])))
            import pandas as pd

            yield pd.DataFrame(rows, columns=[by, "_b", "_a"])

    kind = dict(df.dtypes)[by]
    fitted = moments.mapInPandas(solve, f"`{by}` {kind}, _b array<double>, _a double")
    d = df.join(fitted, by, "left")
    value = F.col("_a")
    for i, n in enumerate(styles):
        value = value + F.element_at("_b", i + 1) * F.col(n)
    return d.withColumn(out, F.when(ok, F.col(y) - value)).drop("_a", "_b")


def quantiles(df: DataFrame, x: str, qs: dict[str, float], by: str, accuracy: int = 10_000) -> DataFrame:
    """by and a column for each of qs: exact quantiles, interpolated as by percentile(), of groups of any size; nulls take no part.

    percentile() holds a group's values in one task. Here a sketch brackets each quantile by ranks that are
    at most 3 / accuracy of the group off; the values below the bracket are counted, those inside are ordered.
    Groups of fewer than 10 * accuracy values are their own bracket.
    """
    v = df.where(F.col(x).isNotNull()).select(by, F.col(x).cast("double").alias("_x"))
    off = 2 / accuracy
    ends = [e for q in qs.values() for e in (max(q - off, 0.0), min(q + off, 1.0))]
    b = v.groupBy(by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"))
    big = F.col("_n") >= 10 * accuracy
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.when(big, F.get("_e", F.lit(2 * i))).alias("lo"), F.when(big, F.get("_e", F.lit(2 * i + 1))).alias("hi")) for i in range(len(qs))])
    d = v.join(F.broadcast(b), by).select(by, "_x", "_n", F.explode(near).alias("_b")).where(F.col("_b.hi").isNull() | (F.col("_x") <= F.col("_b.hi")))
    inside = F.coalesce(F.col("_x") >= F.col("_b.lo"), F.lit(True))
    d = d.groupBy(by, "_n", F.col("_b.i").alias("_i"), F.when(inside, F.col("_x")).alias("_x")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by, "_i").orderBy(F.col("_x").asc_nulls_first())
    d = d.withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(q)) for q in qs.values()]), F.col("_i"))
    holds = lambda k: F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("_x")))
    d = d.withColumns({"_k": F.floor(at), "_h": F.ceil(at), "_p": at}).groupBy(by, "_i").agg(holds(F.col("_k")).alias("_a"), holds(F.col("_h")).alias("_z"), F.max(F.col("_p") - F.col("_k")).alias("_f"))
    value = F.coalesce(F.col("_a") * (1 - F.col("_f")) + F.col("_z") * F.col("_f"), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    return d.groupBy(by).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(qs)])

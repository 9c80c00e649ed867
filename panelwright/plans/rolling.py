"""Linear models fitted over many windows at once, from sums of products by period.

What a fit needs of its rows are sums: of weights, features, labels and their products. They are summed once by
period (and domain); a window's sums are those of its periods, a running frame over that small table, and each
of its rows is one fit. No window is a job of its own and no row is read twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_year(date: Column) -> Column:
    """Half-years numbered through the years."""
    return (F.year(date) * 2 + (F.month(date) > 6).cast("int")).cast("int")


def fits(rows: DataFrame, features: list[str], label: str, period: str, window: int, ridge: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """A row a period (and domain): n, intercept and weights (array, as features) of the fit on the `window` periods before it.

    rows without a label or with a null feature are not learned from. Periods that have fewer than `window`
    before them in the table are left out, and those whose window has no row to learn from. ridge is added to
    1 on the diagonal of the features' correlations, so 0 is least squares; features that don't vary get the
    smallest weights that fit.
    """
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    used = y.isNotNull()
    for f in x:
        used = used & f.isNotNull()
    k = len(x)
    terms = [F.lit(1.0), *x, y] + [x[i] * x[j] for i in range(k) for j in range(i, k)] + [f * y for f in x]
    sums = rows.groupBy(period, *by).agg(*[F.coalesce(F.sum(F.when(used, t)), F.lit(0.0)).alias(f"_s{i}") for i, t in enumerate(terms)])
    before = Window.partitionBy(*by).orderBy(period).rangeBetween(-window, -1)
    first = F.min(period).over(Window.partitionBy(*by))
    d = sums.select(period, *by, first.alias("_first"), *[F.sum(f"_s{i}").over(before).alias(f"_s{i}") for i in range(len(terms))])
    d = d.where((F.col(period) - window >= F.col("_first")) & (F.col("_s0") > 0))
    keys, width = [period, *by], len(terms)

    def solved(batches):
        import pyarrow as pa

        for batch in batches:
            s = np.column_stack([np.asarray(batch.column(len(keys) + i)) for i in range(width)])
            n, mean, my = s[:, 0], s[:, 1 : k + 1] / s[:, :1], s[:, k + 1] / s[:, 0]
            out = np.zeros((len(s), k))
            for r in range(len(s)):
                cov = np.zeros((k, k))
                at = k + 2
                for i in range(k):
                    for j in range(i, k):
                        cov[i, j] = cov[j, i] = s[r, at] / n[r] - mean[r, i] * mean[r, j]
                        at += 1
                cov += ridge * np.diag(np.diag(cov))
                out[r] = np.linalg.lstsq(cov, s[r, at:] / n[r] - mean[r] * my[r], rcond=1e-10)[0]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(n.astype(np.int64)), pa.array(my - (out * mean).sum(1)), pa.array(out.tolist(), pa.list_(pa.float64()))], [*keys, "n", "intercept", "weights"])

    kinds = dict(d.dtypes)
    return d.select(*keys, *[f"_s{i}" for i in range(len(terms))]).mapInArrow(solved, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, intercept double, weights array<double>")


def predicted(rows: DataFrame, models: DataFrame, features: list[str], period: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows of the periods that have a fit, with score; null where a feature is. models has a row a period and domain."""
    d = rows.join(F.broadcast(models.select(period, *by, "intercept", "weights")), [period, *by])
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.col("weights")[i] * F.col(f)
    return d.withColumn("score", score).drop("intercept", "weights")

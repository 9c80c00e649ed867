"""Panel operators on frames made by hand: nulls, ties, partial and flat windows, gaps, late reports."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import elementwise as el
from panelwright.operators import asof, panel, ts, xs
from panelwright.plans import evaluate as ev
from panelwright.sources import tables as src


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def frame(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    x = [1.0, 2.0, 2.0, None, 5.0, 5.0, 5.0, 0.5]
    return spark.createDataFrame([("a", day(i), v, float(i)) for i, v in enumerate(x)] + [("b", day(0), 3.0, 1.0)], "code string, date date, x double, y double")


def values(df, column, code="a"):
    return [r["v"] for r in df.withColumn("v", column).where(F.col("code") == code).orderBy("date").collect()]


def close(a, b):
    return len(a) == len(b) and all((p is None) == (q is None) and (p is None or math.isclose(p, q, abs_tol=1e-9)) for p, q in zip(a, b))


def test_windows_need_all_values(frame):
    assert close(values(frame, ts.mean("x", 3)), [None, None, 5 / 3, None, None, None, 5.0, 3.5])
    assert close(values(frame, ts.mean("x", 3, 1)), [1.0, 1.5, 5 / 3, 2.0, 3.5, 5.0, 5.0, 3.5])
    assert close(values(frame, ts.rolling("x", 2, "sum", 1, last=-1)), [None, 1.0, 3.0, 4.0, 2.0, 5.0, 10.0, 10.0])


def test_rank_takes_ties_at_their_mean(frame):
    assert close(values(frame, ts.rank("x", 3)), [None, None, 2.5 / 3, None, None, None, 2 / 3, 1 / 3])
    assert close(values(frame, xs.rank_pct("x", ("code",))), [2 / 7, 3.5 / 7, 3.5 / 7, None, 6 / 7, 6 / 7, 6 / 7, 1 / 7])


def test_flat_windows_have_no_correlation(frame):
    assert values(frame, ts.corr("x", "y", 3))[6] is None
    assert values(frame, ts.zscore("x", 3, 3))[6] is None


def test_argmax_counts_from_the_start(frame):
    assert values(frame, ts.argmax("x", 3)) == [None, None, 1, 0, 2, 1, 0, 0]


def test_last_known_and_decay(frame):
    assert values(frame, ts.last_known("x"))[3] == 2.0
    assert close(values(frame, ts.decay_linear("y", 3)), [None, None, 8 / 6, 14 / 6, 20 / 6, 26 / 6, 32 / 6, 38 / 6])


def test_cooled_down_counts_from_the_last_kept(spark):
    d = spark.createDataFrame([("a", day(i), i in (1, 2, 3, 4, 8)) for i in range(10)], "code string, date date, hit boolean")
    kept = [r["date"] for r in ts.cooled_down(d, "hit", 2).where("kept").orderBy("date").collect()]
    assert kept == [day(1), day(4), day(8)]


def test_held_cost_equals_the_recursion(spark):
    r = np.random.default_rng(0)
    p, u = r.uniform(1, 9, 50), r.uniform(0, 0.9, 50)
    d = spark.createDataFrame([("a", day(i), float(p[i]), float(u[i])) for i in range(50)], "code string, date date, p double, u double")
    got = [x["c"] for x in ts.held_cost(d, "p", "u", "c", block=7).orderBy("date").collect()]
    c = p[0]
    for i in range(1, 50):
        c = c * (1 - u[i]) + p[i] * u[i]
        assert abs(got[i] - c) < 1e-6


def test_elementwise_nulls(spark):
    d = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (-4.0, 2.0), (float("inf"), 1.0)], "a double, b double")
    rows = d.select(el.safe_div(F.col("a"), F.col("b")), el.pair_max(F.col("a"), F.col("b")), el.guarded_log(F.col("a")), el.if_else(F.col("a") > 0, F.lit(1), F.lit(0))).collect()
    assert [r[0] for r in rows] == [None, None, -2.0, None]
    assert rows[1][1] is None and rows[2][2] is None and rows[1][3] == 0


def test_asof_ties_staleness_and_order(spark):
    left = spark.createDataFrame([("a", day(i)) for i in (0, 5, 9, 40)] + [("z", day(1))], "code string, date date")
    right = spark.createDataFrame([("a", day(5), 1.0), ("a", day(5), 2.0), ("a", day(7), None)], "code string, date date, v double")
    got = {(r["code"], r["date"]): r["v"] for r in asof.asof(left, right, ["v"]).collect()}
    assert got == {("a", day(0)): None, ("a", day(5)): 2.0, ("a", day(9)): None, ("a", day(40)): None, ("z", day(1)): None}
    strict = {r["date"]: r["v"] for r in asof.asof(left, right, ["v"], strict=True).collect() if r["code"] == "a"}
    assert strict[day(5)] is None
    fresh = {r["date"]: r["v"] for r in asof.asof(left, right.where("v is not null"), ["v"], within_days=10).collect() if r["code"] == "a"}
    assert fresh[day(9)] == 2.0 and fresh[day(40)] is None


def test_windows_of_events(spark):
    b = spark.createDataFrame([("a", day(i)) for i in range(0, 30, 7)], "code string, date date")
    e = spark.createDataFrame([("a", day(3), 1.0), ("a", day(10), 5.0)], "code string, date date, v double")
    got = [r["s"] for r in asof.in_windows(b, e, -10, 0, "v", "s").orderBy("date").collect()]
    assert got == [0.0, 1.0, 5.0, 0.0, 0.0] or got == [0.0, 1.0, 5.0, 5.0, 0.0]


def test_neutralize_equals_least_squares(spark):
    r = np.random.default_rng(1)
    g, s, y = r.integers(0, 4, 60), r.uniform(1, 9, 60), r.standard_normal(60)
    d = spark.createDataFrame([(day(0), str(i), float(y[i]), float(s[i]), str(g[i])) for i in range(60)], "date date, code string, y double, s double, g string")
    got = {int(x["code"]): x["e"] for x in xs.neutralize(d, "y", "s", "g", "e").collect()}
    a = np.column_stack([np.log(s), *[(g == k).astype(float) for k in range(4)]])
    want = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(60))
    many = {int(x["code"]): x["e"] for x in xs.residual_many(d.withColumn("t", F.col("s") * F.col("s")), "y", ["s", "t"], "e", least=10).collect()}
    a = np.column_stack([np.ones(60), s, s * s])
    want = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert all(abs(many[i] - want[i]) < 1e-8 for i in range(60))


def test_dense_grid_and_upsert(spark):
    d = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 2.0), ("b", day(1), 3.0)], "code string, date date, close double")
    assert panel.dense(d).count() == 6 and panel.dense(d, clipped=True).count() == 4
    new = spark.createDataFrame([("a", day(2), 9.0), ("c", day(0), 1.0)], "code string, date date, close double")
    got = {(r["code"], r["date"]): r["close"] for r in src.upserted(d, new, ["code", "date"]).collect()}
    assert got[("a", day(2))] == 9.0 and len(got) == 4


def test_history_does_not_move_when_the_future_does(spark):
    r = np.random.default_rng(2)
    d = spark.createDataFrame([(c, day(i), float(v)) for c in "abc" for i, v in enumerate(r.uniform(1, 9, 30))], "code string, date date, close double")
    later = d.withColumn("close", F.when(F.col("date") > day(15), F.col("close") * 2.7 + 1.4).otherwise(F.col("close")))
    ops = [ts.mean("close", 5), ts.rank("close", 5), ts.change("close", 3), ts.quantile("close", 6, 0.3, 2), xs.rank_pct("close"), xs.zscore("close")]
    for op in ops:
        f = lambda x: sorted((r["code"], r["date"], round(r["v"], 9)) for r in x.withColumn("v", op).where(F.col("date") <= day(15)).collect() if r["v"] is not None)  # noqa: B023, E731
        assert f(d) == f(later) == f(d.repartition(5))


def test_rank_ic_by_hand(spark):
    rows = [("f", day(0), str(i), float(i), float(v)) for i, v in enumerate([1, 2, 2, 5, 9])]
    d = spark.createDataFrame(rows, "factor string, date date, code string, value double, fwd_1 double")
    r = ev.daily_ic(d, (1,), least=3).first()
    assert r["n"] == 5 and abs(r["rank_ic"] - np.corrcoef([1, 2, 3, 4, 5], [1, 2, 2, 4, 5])[0, 1]) < 1e-9


def test_pair_correlation_without_pairs(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((20, 5))
    d = spark.createDataFrame([("g", str(j), day(i), float(x[i, j])) for i in range(20) for j in range(5)], "g string, code string, date date, r double")
    c = np.corrcoef(x.T)
    assert abs(ev.pair_corr_mean(d, "r", "g").first()["rho"] - c[np.triu_indices(5, 1)].mean()) < 1e-9


def test_a_product_does_not_pass_over_what_takes_all_or_more(spark):
    d = spark.createDataFrame([("a", i, r) for i, r in enumerate([0.5, -1.0, 0.5])] + [("b", i, r) for i, r in enumerate([-0.5, None, -1.5, 0.5])], "code string, date int, r double")
    got = {(r["code"], r["date"]): (r["v"], r["s"]) for r in d.select("code", "date", ts.compounded("r").alias("v"), ts.survival(-F.col("r")).alias("s")).collect()}
    assert [got["a", i][0] for i in range(3)] == pytest.approx([1.5, 0.0, 0.0])
    assert [got["b", i][0] for i in range(2)] == pytest.approx([0.5, 0.5])
    assert all(v != v for i in (2, 3) for v in got["b", i]) and got["a", 2][1] == 0.0


def test_a_product_of_ranks_passes_the_int_range(spark):
    d = spark.range(50_000).select(F.lit(1).alias("date"), F.col("id").cast("double").alias("x"))
    assert d.select(xs.rank_product("x", "x").alias("p")).agg(F.max("p")).first()[0] == 2_500_000_000


def test_quantiles_of_large_groups_are_exact_and_leave_the_rest_unsorted(spark):
    d = spark.range(3000).select(F.when(F.col("id") < 2900, "a").otherwise("b").alias("k"), F.when(F.col("id") % 7 > 0, F.pmod(F.col("id") * 7919, F.lit(1009)) / 8 - 20).alias("x"))
    qs = {"a0": 0.0, "q01": 0.01, "q50": 0.5, "q99": 0.99, "a1": 1.0}
    for accuracy in (100, 10_000):
        got = {r["k"]: [r[n] for n in qs] for r in xs.quantiles(d, "x", qs, "k", accuracy).collect()}
        want = {r["k"]: [r[n] for n in qs] for r in d.groupBy("k").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in qs.items()]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

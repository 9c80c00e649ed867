"""Section kernels against the operators that they stand for, and plans that sort a section once."""

import math

from pyspark.sql import functions as F

from panelwright.catalog import judging
from panelwright.catalog.fixtures import nulls_for_errors
from panelwright.operators import xs
from panelwright.plans import across, formulas

SF = "/root/testdata/sf0.001"
KINDS = {"rank": lambda: xs.rank("x"), "rank_pct": lambda: xs.rank_pct("x"), "settled": lambda: xs.rank_pct(formulas.settled(F.col("x"))), "scale": lambda: xs.scale("y")}


def made(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("d1", f"c{i}", [None, 1.0, 2.0, 2.0, nan, nan, inf, -0.0, 0.0, 2.0 + 1e-13][i % 10], float(i - 20)) for i in range(45)]
    rows += [("d2", f"c{i}", None, 0.0) for i in range(3)] + [("d3", "c0", 7.0, None), ("d4", "c0", 1.0, 3.0)] + [(None, "c0", 1.0, 2.0), (None, "c1", 1.0, 6.0)]
    return spark.createDataFrame(rows, "d string, code string, x double, y double").withColumn("date", F.when(F.col("d").isNotNull(), F.date_add(F.lit("2020-01-01").cast("date"), F.substring("d", 2, 1).cast("int"))))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_equal_the_operators(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        with nulls_for_errors(spark):
            want = {(r.date, r.code): r for r in made(spark).select("date", "code", *[f().cast("double").alias(k) for k, f in KINDS.items()]).collect()}
            got = across.with_values(made(spark), {"_x": F.col("x"), "_y": F.col("y")}, [(k, k, "_y" if k == "scale" else "_x") for k in KINDS], ["date", "code"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) == 52
    for r in got:
        for k in KINDS:
            a, b = r[k], want[r.date, r.code][k]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12)), (k, r, b)


def test_formulas_plan_no_window_across_dates(spark):
    c = formulas.column("x")
    out = formulas.evaluate(made(spark), {"a": formulas.XRANK(c) + formulas.XRANK(-c), "b": formulas.XSCALE(formulas.XRANK(c))})
    assert "Window" not in plan(out)
    assert out.where("a is not null").count() > 0


def test_the_composite_is_made_of_one_row_a_code(spark):
    with nulls_for_errors(spark):
        p = plan(judging._composite(spark, SF))
    assert "Generate" not in p and p.count("Aggregate") == 1 and "rank(" not in p


def test_trees_learn_from_a_table_that_is_written_once(spark):
    with nulls_for_errors(spark):
        out = judging._boosted(spark, SF)
    assert "Aggregate" not in plan(out) and "Join" not in plan(out)
    assert out.where("score is not null").count() > 0


def test_shuffles_are_made_once(spark):
    with nulls_for_errors(spark):
        assert plan(judging._permuted(spark, SF)).count("FlatMapGroupsInArrow") == 1


def test_daily_metrics_plan_no_window_across_dates(spark):
    with nulls_for_errors(spark):
        p = judging._metrics(spark, SF)._jdf.queryExecution().optimizedPlan()
        windows = [x for x in p.toString().splitlines() if "Window" in x]
    assert windows and not any("rank(" in x or "factor" in x for x in windows)


def test_daily_metrics_of_a_small_table(spark):
    """Two factors, one of them partly null, against figures worked out by hand."""
    rows = [(day, f"c{i}", 10.0 + i + day * (i % 3), float((i * 7 + day) % 10), float(i) if i % 2 else None) for day in range(3) for i in range(10)]
    d = spark.createDataFrame(rows, "day int, code string, close double, a double, b double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))
    got = {(r.factor, r.date.day): r for r in judging.ev.daily_metrics(d, ["a", "b"], (1,), (1,), 3).collect()}
    assert len(got) == 6
    r = got["b", 2]
    assert (r.rows, r.n, r.coverage, r.degraded, r.q50) == (10, 5, 0.5, False, 5.0)
    assert r.auto_1 == 1.0 and r.turnover_1 == 0.0 and r.turnover_5 == 0.0
    assert got["a", 1].turnover_1 is None and got["a", 3].ic_1 is None and got["a", 1].ret_1_1 is not None
    a = {(x[0], x[1]): x for x in rows}
    low = [f"c{i}" for i in sorted(range(10), key=lambda i: a[1, f"c{i}"][3])[:2]]
    assert math.isclose(got["a", 2].ret_1_1, sum(a[2, c][2] / a[1, c][2] - 1 for c in low) / 2)

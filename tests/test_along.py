"""Window kernels against the operators that they stand for."""

import math

import numpy as np
from pyspark.sql import functions as F

from panelwright.catalog.fixtures import nulls_for_errors
from panelwright.operators import ts
from panelwright.plans import along, formulas

OPERATORS = {"lag": (ts.delay, 3), "diff": (ts.delta, 2), "mean": (ts.mean, 7), "std": (ts.std, 5), "sum": (ts.total, 6), "min": (ts.low, 4), "max": (ts.high, 4), "corr": (ts.corr, 3), "cov": (ts.cov, 4), "argmax": (ts.argmax, 5), "tsrank": (lambda x, d: ts.rank(formulas.settled(F.col(x)), d), 6), "decay": (ts.decay_linear, 4)}


def made(spark, codes=40, days=60):
    rng = np.random.default_rng(4)
    some = lambda: None if rng.random() < 0.08 else float(np.round(rng.normal() * 3, int(rng.integers(0, 9))))
    rows = [(f"c{i}", t, some(), some()) for i in range(codes) for t in range(days + i % 5)] + [("one", 0, 1.0, 2.0), ("still", 0, 5.0, 1.0), ("still", 1, 5.0, 2.0), ("still", 2, 5.0, 3.0)]
    return spark.createDataFrame(rows, "code string, t int, x double, y double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t")))


def test_kernels_equal_the_operators(spark, monkeypatch):
    monkeypatch.setattr(along, "BLOCK", 500)
    d, two = made(spark), {"corr", "cov"}
    with nulls_for_errors(spark):
        want = {(r.code, r.date): r for r in d.select("code", "date", *[(f("x", "y", n) if k in two else f("x", n)).cast("double").alias(k) for k, (f, n) in OPERATORS.items()]).collect()}
    ordered = d.repartition(3, "code").sortWithinPartitions("code", "date").select("code", "date", "x", "y")
    asked = [(k, k, ["x", "y"] if k in two else ["x"], (n,)) for k, (_, n) in OPERATORS.items()]
    got = ordered.mapInArrow(lambda b: along.values(b, ["code", "date"], asked), "code string, date date, " + ", ".join(f"{k} double" for k in OPERATORS)).collect()
    assert len(got) == len(want)
    for r in got:
        for k in OPERATORS:
            a, b = r[k], want[r.code, r.date][k]
            assert (a is None) == (b is None or not math.isfinite(b)) and (a is None or a == b), (k, a, b)


def test_windows_that_pass_over_nulls_equal_the_operators(spark, monkeypatch):
    monkeypatch.setattr(along, "BLOCK", 500)
    made_of = {
        "lag": lambda: ts.delay("x", 3), "change": lambda: ts.change("x", 20), "mean": lambda: ts.mean("x", 7, 2), "total": lambda: ts.total("y", 6, 4), "sd": lambda: ts.std("x", 5, 2), "low": lambda: ts.low("y", 11, 1), "high": lambda: ts.high("x", 50, 1),
        "before": lambda: ts.rolling("x", 25, "stddev_samp", 10, last=-1), "counted": lambda: ts.rolling("x", 25, "count", last=-1), "z": lambda: ts.zscore("x", 12, 6), "corr": lambda: ts.corr("x", "y", 8, 4), "slope": lambda: ts.slope("x", "y", 9, 0.5),
        "twice": lambda: ts.mean(ts.delta("x") + F.col("y"), 5, 2), "dated": lambda: F.col("x") - F.avg("x").over(ts.rows(-2, 2)),
    }
    d = made(spark).withColumn("x", F.when((F.col("code") == "c3") & (F.col("t") == 30), float("nan")).when((F.col("code") == "c5") & (F.col("t") == 30), float("inf")).otherwise(F.col("x")))
    with nulls_for_errors(spark):
        want = {(r.code, r.date): r for r in d.select("code", "date", *[f().cast("double").alias(k) for k, f in made_of.items()]).collect()}
        got, _ = along.with_columns(d, made_of)
        rows = got.select("code", "date", *[F.col(k).cast("double").alias(k) for k in made_of]).collect()
    assert len(rows) == len(want)
    for r in rows:
        for k in made_of:
            a, b = r[k], want[r.code, r.date][k]
            assert (a is None) == (b is None) and (a is None or a == b or math.isnan(a) and math.isnan(b)), (k, r.code, r.date, a, b)


def test_factors_of_long_windows_plan_no_window_along_codes(spark):
    from panelwright.plans.registry import Factor, Reach, Registry

    r = Registry()
    r.add(Factor("sd", {"t": ("x",)}, column=lambda: ts.rolling("x", 250, "stddev_samp", 2, last=-1), reach=Reach(250)))
    out = r.compute(["sd"], {"t": made(spark, 5, 20)})
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("value is not null").count() > 0


def test_formulas_plan_no_window_along_codes(spark):
    f = {"a": formulas.CORR(formulas.column("x"), formulas.MEAN(formulas.column("y"), 3), 4), "b": formulas.TSRANK(formulas.column("x"), 5)}
    out = formulas.evaluate(made(spark, 5, 20), f)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("a is not null").count() > 0

"""Statement plans by hand: reports that overtake each other, forecasts, decayed events, minute regressions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelwright.catalog.refined import lagged_regression
from panelwright.catalog.strategies import weekday_dates
from panelwright.plans import fundamentals as fu
from panelwright.plans import reports

D = dt.date
#: The second quarter is published after the third.
ITEMS = [("a", D(2020, 3, 31), D(2020, 4, 10), 8081, 10.0), ("a", D(2020, 6, 30), D(2020, 12, 1), 8082, 99.0), ("a", D(2020, 9, 30), D(2020, 10, 15), 8083, 15.0), ("a", D(2020, 12, 31), D(2021, 1, 20), 8084, 30.0)]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "code string, period date, notice date, q int, revenue double")


def bars(spark, days):
    return spark.createDataFrame([("a", d, 1.0) for d in days], "code string, date date, close double")


def test_a_report_is_compared_with_what_was_out(spark):
    got = {r["date"]: r["value"] for r in reports.report_change(bars(spark, [D(2020, 10, 14), D(2020, 10, 15), D(2021, 1, 20)]), items(spark)).collect()}
    # in October the second quarter was not out: the third is compared with the first; in January it is the second's successor
    assert got == {D(2020, 10, 14): None, D(2020, 10, 15): 0.5, D(2021, 1, 20): 1.0}


def test_ladder_drops_overtaken_periods(spark):
    steps = {r["known"]: r["value"] for r in fu.ladder(items(spark), F.col("revenue")).collect()}
    assert steps == {D(2020, 4, 10): 10.0, D(2020, 10, 15): 15.0, D(2021, 1, 20): 30.0}


def test_trailing_needs_every_quarter(spark):
    rows = [("a", D(2020, 1, 1), D(2020, 1, 1), q, float(q)) for q in (1, 2, 3, 4, 6, 7, 8, 9)]
    got = {r["q"]: r["revenue_ttm"] for r in fu.trailing(items(spark, rows), ["revenue"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 10.0, 6: None, 7: None, 8: None, 9: 30.0}


def test_published_before_counts_by_publication(spark):
    got = {r["q"]: [x["q"] for x in r["_before"]] for r in fu.published_before(items(spark), "revenue", 2).collect()}
    assert got == {8081: [], 8082: [8081], 8083: [8081], 8084: [8083, 8082]}


def test_decayed_events(spark):
    events = spark.createDataFrame([("a", D(2020, 1, 1), 2.0), ("a", D(2020, 1, 1), 4.0), ("a", D(2020, 1, 31), -1.0)], "code string, known date, value double")
    days = [D(2019, 12, 31), D(2020, 1, 1), D(2020, 2, 10), D(2020, 3, 30), D(2020, 3, 31), D(2020, 5, 1)]
    got = {r["date"]: r["value"] for r in fu.decayed_events(bars(spark, days), events).collect()}
    age = lambda d, e: (d - e).days
    d = D(2020, 2, 10)
    a, b = 90 - age(d, D(2020, 1, 1)), 90 - age(d, D(2020, 1, 31))
    assert got[D(2019, 12, 31)] is None and abs(got[D(2020, 1, 1)] - 3) < 1e-9 and abs(got[d] - (3 * a - b) / (a + b)) < 1e-9
    assert abs(got[D(2020, 3, 31)] + 1) < 1e-9 and got[D(2020, 5, 1)] is None


def test_forecasts_know_only_what_was_out(spark):
    rows = [("a", D(2000 + q // 4, 3 * (q % 4) + 3, 28), D(2000 + q // 4, 3 * (q % 4) + 3, 28) + dt.timedelta(20), q, 100.0 + (q * 7) % 13 + q) for q in range(24)]
    f = spark.createDataFrame([("a", D(2006, 3, 28), 24, D(2006, 4, 1), 110.0, 130.0), ("a", D(2006, 3, 28), 24, D(2005, 1, 1), 110.0, 130.0)], "code string, period date, q int, known date, low double, high double")
    got = fu.forecast_surprise(items(spark, rows), f, "revenue").collect()
    x = np.array([r[4] for r in rows])
    change = x[4:] - x[:-4]
    delta = np.array([np.nan if i < 4 else change[max(0, i - 8) : i].mean() for i in range(20)])
    error = change - delta
    i = 18  # quarter 22: the 23rd was published after the first forecast came out, on 17 January: known
    i = 19
    sigma = np.std(error[max(4, i - 8) : i], ddof=1)
    assert [r["known"] for r in got] == [D(2006, 4, 1)]  # in 2005 the base quarter was not out
    assert abs(got[0]["value"] - np.clip((120.0 - x[20] - delta[i]) / sigma, -10, 10)) < 1e-9


def test_weekday_dates(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(14) if i not in (2, 5, 6, 12, 13)]  # the first week has no Wednesday
    got = {(r["weekday"], r["date"]): r["next"] for r in weekday_dates(spark.createDataFrame([(d,) for d in days], "date date")).collect()}
    assert got[3, D(2024, 1, 1)] == D(2024, 1, 10) and got[2, D(2024, 1, 2)] == D(2024, 1, 9) and got[5, D(2024, 1, 12)] is None


def test_lagged_regression_against_numpy(spark):
    r = np.random.default_rng(2)
    n = 80
    close, vol = 10 * np.exp(np.cumsum(r.standard_normal(n) * 0.01)), r.integers(1, 50, n).astype(float)
    start = dt.datetime(2024, 1, 1, 9)
    m = spark.createDataFrame([("a", start.date(), start + dt.timedelta(minutes=i), float(close[i]), float(vol[i])) for i in range(n)], "code string, date date, datetime timestamp, close double, vol double")
    got = lagged_regression(m).first()
    y, dv = np.diff(np.log(close)), np.diff(vol)
    rows = range(5, n - 1)
    x = np.array([[1, *[dv[i - k] for k in range(1, 6)]] for i in rows])
    y = y[5:]
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss, tss = ((y - x @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    var = rss / (len(y) - 6)
    t = beta / np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * var)
    assert got["n"] == len(y) and np.allclose(got["t"], t[1:], rtol=1e-6) and np.isclose(got["f"], (tss - rss) / 5 / var, rtol=1e-6)


def test_a_history_that_does_not_vary_counts_as_the_least_surprise(spark):
    rows = [(k, D(2020, 1, 1) + dt.timedelta(days=90 * i), D(2020, 2, 1) + dt.timedelta(days=90 * i), 8080 + i, v) for k, x in (("a", [0.1] * 7), ("b", [0.1] * 6 + [0.7])) for i, v in enumerate(x)]
    d = items(spark, rows)
    for f in (fu.zscore_before, fu.zscore_published):
        got = {(r["code"], r["q"]): r["value"] for r in f(d, "revenue").collect()}
        assert got["a", 8086] == got["b", 8086] == -10.0 and got["a", 8085] is None

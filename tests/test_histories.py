"""Event paths and state histories by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.plans import events as ev
from panelwright.plans import states as st

DAY = [dt.date(2020, 1, i) for i in range(1, 12)]


@pytest.fixture(scope="module")
def bars(spark):
    rets = {"a": [None, 0.0, 0.1, -0.05, -0.2, 0.3, 0.1], "b": [None, 0.02, 0.02, 0.02, 0.02, 0.02, 0.02]}
    return spark.createDataFrame([(c, DAY[i], r, c == "a" and i == 1 or c == "b" and i in (0, 4)) for c, rs in rets.items() for i, r in enumerate(rs)], "code string, date date, ret double, hit boolean")


def test_paths_end_at_the_stop_at_the_hold_or_at_the_table(bars):
    got = {}
    for r in ev.paths(bars, F.col("hit"), 4, 0.1).orderBy("k").collect():
        got.setdefault((r["code"], r["opened"]), []).append((r["k"], r["date"], r["ret"], r["last"], r["stopped"]))
    # a: 1.1, 1.045, 0.836: the third row is at or below 0.9
    assert got["a", DAY[1]] == [(1, DAY[2], 0.1, False, False), (2, DAY[3], -0.05, False, False), (3, DAY[4], -0.2, True, True)]
    assert [x[3] for x in got["b", DAY[0]]] == [False, False, False, True] and not any(x[4] for x in got["b", DAY[0]])
    assert [x[3] for x in got["b", DAY[4]]] == [False, False]  # cut off, not closed
    assert ev.paths(bars, F.col("hit"), 4).where("code = 'a'").count() == 4


def test_the_book_charges_the_shares_that_enter_and_leave(bars):
    day = {r["date"]: r for r in ev.book(ev.paths(bars, F.col("hit"), 4, 0.1), 0.01, 0.02).collect()}
    x = day[DAY[4]]  # a's third and last row, b's fourth and last
    assert (x["n"], x["exits"], x["entries"], x["stops"]) == (2, 1.0, 0.0, 1)
    assert x["ret"] == pytest.approx((-0.2 + 0.02) / 2) and x["net"] == pytest.approx(x["ret"] - 0.02)
    assert day[DAY[2]]["entries"] == 0.5 and ev.paths(bars, F.lit(False), 3).count() == 0


RULES = [("^S ", 1), ("gone", 9)]


def test_names_in_one_state_are_one_interval(spark):
    log = [("a", "x", DAY[0], 1), ("a", "S x", DAY[2], 2), ("a", "S y", DAY[3], 3), ("a", "y", DAY[5], 4), ("a", "S z", DAY[5], 3), ("a", "y gone", DAY[7], 5), ("b", "S b", DAY[4], 1), ("b", None, DAY[6], 2), ("c", "S c", None, 1)]
    d = spark.createDataFrame(log, "code string, name string, start date, announced int")
    got = sorted((r["code"], r["start"], r["until"], r["state"]) for r in st.intervals(d.unionByName(d), RULES).collect())
    assert got == [("a", DAY[0], DAY[2], 0), ("a", DAY[2], DAY[5], 1), ("a", DAY[5], DAY[7], 0), ("a", DAY[7], None, 9), ("b", DAY[4], DAY[6], 1), ("b", DAY[6], None, 0)]
    panel = spark.createDataFrame([(c, day) for c in "abd" for day in DAY], "code string, date date")
    on = {(r["code"], r["date"]): r["state"] for r in st.on_dates(panel, d, RULES).collect()}
    assert [on["a", x] for x in DAY[:9]] == [0, 0, 1, 1, 1, 0, 0, 9, 9] and on["b", DAY[3]] == 0 and on["b", DAY[4]] == 1 and on["d", DAY[9]] == 0 and len(on) == 33

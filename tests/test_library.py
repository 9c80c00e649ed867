"""The library of factors over stored tables: ranges are exact and read less, and leaks are found."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import panel, ts
from panelwright.plans import registry as rg
from panelwright.plans import replay as rp
from panelwright.plans.library import LIBRARY

DAYS = [dt.date(2021, 1, 4) + dt.timedelta(i) for i in range(420) if (dt.date(2021, 1, 4) + dt.timedelta(i)).weekday() < 5]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Bars with gaps, flows and shares, stored by year."""
    rng = np.random.default_rng(1)
    bars, flow, flows = [], [], []
    for k, code in enumerate("abcdef"):
        price = 10.0 + k
        for i, day in enumerate(DAYS):
            if k == 2 and 100 < i < 190 or k == 4 and i > 200 or rng.random() < 0.1:
                continue
            price *= float(np.exp(rng.normal(0, 0.02)))
            low, high = price * 0.99, price * 1.015
            bars.append((code, day, float(rng.uniform(low, high)), high, low, price, float(rng.integers(100, 999)), float(rng.uniform(1e5, 9e5)), day.year))
            flow.append((code, day, float(rng.normal(0, 1e4))))
            flows.append((code, day, float(rng.normal(0, 1e3)), float(rng.normal(0, 1e4))))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(bars, "code string, date date, open double, high double, low double, close double, vol double, amount double, year int").write.partitionBy("year").parquet(f"{folder}/bars")
    spark.createDataFrame(flow, "code string, date date, main_net double").write.parquet(f"{folder}/flow")
    spark.createDataFrame(flows, "code string, date date, small_net double, net_amount double").write.parquet(f"{folder}/flows")
    spark.createDataFrame([(c, dt.date(2020, 1, 1), 1e4, 2e4) for c in "abcdef"], "code string, date date, float_shares double, total_shares double").write.parquet(f"{folder}/capital")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("bars", "flow", "flows", "capital")}


NAMES = ["momentum_20", "volatility_20", "rsi_14", "turnover_std_20", "turn_idio_20", "qz_idio_illiq_20", "qz_tsim_path_20", "boat_follow_20", "mf_smart_dumb_20", "anchor_rev_vol_20", "jump_share_20", "ev_high_vol_20", "team_coin_20", "total_mcap"]


def values(df):
    return {(r["factor"], r["date"], r["code"]): r["value"] for r in df.collect()}


def test_every_factor_has_inputs_and_a_known_reach():
    assert len(LIBRARY.names()) > 130
    for n in LIBRARY.names():
        assert LIBRARY.sources(n) <= set(LIBRARY.tables) and LIBRARY.sources(n)
    assert LIBRARY.reach("momentum_20") == rg.Reach(21, 1) and LIBRARY.reach("chip_cost_bias").rows is None and LIBRARY.reach("dividend_yield").days == 364


def test_a_range_equals_the_whole_run_and_reads_less(tables):
    first, last = "2022-01-10", "2022-01-21"
    whole = {k: v for k, v in values(LIBRARY.compute(NAMES, tables)).items() if first <= str(k[1]) <= last}
    some = values(LIBRARY.compute(NAMES, tables, first=first, last=last))
    assert set(some) == set(whole) and len(some) > 14 * 40
    for k, v in whole.items():
        assert some[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)), k
    cut = LIBRARY.pruned(NAMES, tables, first, last)
    assert cut["bars"].agg(F.min("date")).first()[0] > dt.date(2021, 3, 1)  # though a code was away for 90 days


def test_the_range_reaches_the_scan(tables):
    plan = LIBRARY.compute(["momentum_20", "volatility_20"], tables, first="2022-01-10", last="2022-01-21")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line or "Scan parquet" in line]
    assert scans and all("GreaterThanOrEqual(date,2021-" in s and "LessThanOrEqual(date,2022-01-21)" in s for s in scans)
    assert "vol" not in scans[0].split("ReadSchema")[1] or "volume" in scans[0]


def test_names_that_mean_two_things_are_refused(tables):
    r = rg.Registry(LIBRARY.tables.values())
    r.add(rg.Factor("one", {"bars": ("close",)}, column=lambda: F.col("_x"), steps=({"_x": lambda: F.col("close") * 2},)))
    r.add(rg.Factor("two", {"bars": ("close",)}, column=lambda: F.col("_x"), steps=({"_x": lambda: F.col("close") * 3},)))
    with pytest.raises(ValueError, match="means one thing"):
        r.compute(["one", "two"], tables)


def leaky():
    """The library's price factors, and three that know the future: the next close, a mean around the date, and a rank over the whole history."""
    r = rg.Registry(LIBRARY.tables.values())
    r.frames = dict(LIBRARY.frames)
    for n in NAMES:
        r.add(LIBRARY.get(n))
    r.add(rg.Factor("next", {"priced": ()}, column=lambda: panel.forward_return("close", 1), reach=rg.Reach(1)))
    r.add(rg.Factor("centred", {"priced": ()}, column=lambda: F.avg("close").over(ts.rows(-2, 2)), reach=rg.Reach(2)))
    r.add(rg.Factor("of_all", {"priced": ()}, column=lambda: F.col("close") / F.max("close").over(ts.rows(None, 10**6)), reach=rg.Reach(None)))
    return r


LEAKS = ("next", "centred", "of_all")
CUTS = [dt.date(2021, 11, 1), dt.date(2022, 1, 12), dt.date(2022, 2, 25)]


def test_only_leaking_factors_differ_when_inputs_end(tables):
    r = leaky()
    got = {(x["factor"], x["cut"]): x for x in rp.replay(r, r.names(), tables, CUTS).collect()}
    assert len(got) == len(r.names()) * 3
    section = {cut: tables["bars"].where(F.col("date") == F.lit(cut)).count() for cut in CUTS}
    for (name, cut), x in got.items():
        assert x["n"] == section[cut]
        assert (x["different"] > 0) == (name in LEAKS and cut != DAYS[-1]), (name, cut, x)  # nothing comes after the last day


def test_only_leaking_factors_move_when_the_future_is_scrambled(tables):
    r = leaky()
    got = {(x["factor"], x["cut"]): x for x in rp.replay(r, r.names(), tables, CUTS[:2], scramble=True, look=30).collect()}
    for (name, cut), x in got.items():
        assert (x["different"] > 0) == (name in LEAKS), (name, cut, x)
        assert x["n"] > 60


def test_cuts_are_bounded(tables):
    with pytest.raises(ValueError, match="cuts"):
        rp.replay(LIBRARY, ["size"], tables, [dt.date(2000, 1, i + 1) for i in range(19)])
    with pytest.raises(ValueError, match="no factors"):
        rp.replay(LIBRARY, [], tables, CUTS)


def test_stored_frames_give_the_same_values_and_are_read_back(tables):
    some = ["momentum_20", "team_coin_20", "boat_follow_20"]
    plain, stored = LIBRARY.compute(some, tables), LIBRARY.compute(some, LIBRARY.stored(some, tables), store=True)
    assert values(plain) == values(stored)
    scans = [line for line in stored._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scans and all("/priced-" in s for s in scans)

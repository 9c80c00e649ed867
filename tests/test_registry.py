"""The factor registry, weight methods and section correlations against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ts
from panelwright.plans import evaluate as ev
from panelwright.plans import registry as rg
from panelwright.plans import weights as wt


def made():
    r = rg.Registry()
    r.add(rg.Factor("move", {"panel": ("close",)}, "price", column=lambda: ts.change("close", 1)))
    r.add(rg.Factor("level", {"panel": ("close",), "state": ("board",)}, "state", sql="SELECT code, date, close AS value FROM {panel} JOIN {state} USING (code) LEFT SEMI JOIN {universe} USING (code)"))
    r.add(rg.Factor("nothing", {"panel": ("close",)}, column=lambda: F.lit(None).cast("double")))
    return r


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(i), float(10 + k + i * (k + 1))) for k, c in enumerate("ab") for i in range(6)]
    return {"panel": spark.createDataFrame(rows, "code string, date date, close double"), "state": spark.createDataFrame([("a", "x"), ("b", "y")], "code string, board string")}


def test_registry_refuses_what_it_cannot_use():
    r = made()
    with pytest.raises(ValueError, match="twice"):
        r.add(rg.Factor("move", {"panel": ()}, sql=""))
    with pytest.raises(ValueError, match="one of"):
        r.add(rg.Factor("none", {"panel": ()}))
    with pytest.raises(KeyError, match="no factor"):
        r.get("other")
    assert r.names("price") == ["move"] and r.caveats({"state": ["board"]}) == {"level": ["state.board"]}


def test_compute_over_ranges_and_universes(spark, tables):
    r = made()
    some = spark.createDataFrame([("a",)], "code string")
    d = r.compute(["move", "level"], tables, some, "2020-01-02", "2020-01-03").collect()
    assert {(x["factor"], x["code"]) for x in d} == {("move", "a"), ("level", "a")} and len(d) == 4
    assert {x["value"] for x in d if x["factor"] == "move"} == {11 / 10 - 1, 12 / 11 - 1}  # the window reached back over the cut
    with pytest.raises(KeyError, match="reads"):
        r.compute(["level"], {"panel": tables["panel"]})
    assert {x["factor"] for x in r.described(spark).collect()} == {"move", "level", "nothing"}


def test_saving_checks_and_merges(spark, tables, tmp_path):
    r, folder = made(), str(tmp_path / "lake")
    first = r.compute(["move", "nothing"], tables, last="2020-01-04")
    assert rg.save(first, folder) == ["move"]
    changed = r.compute(["move"], tables, first="2020-01-04").withColumn("value", F.col("value") + 1)
    assert rg.save(changed, folder, "merge") == ["move"]
    got = {(x["code"], str(x["date"])): x["value"] for x in spark.read.parquet(folder).collect()}
    assert len(got) == 10 and got["a", "2020-01-04"] > 1 and got["a", "2020-01-03"] < 1
    with pytest.raises(ValueError, match="mode"):
        rg.save(first, folder, "append")


def test_weights_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((40, 4)) * [0.01, 0.02, 0.03, 0.04] + r.standard_normal((40, 1)) * 0.01
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    ret = spark.createDataFrame([(days[i], f"c{k}", float(x[i, k])) for i in range(40) for k in range(4)], "date date, code string, ret double")
    held = spark.createDataFrame([(days[-1], f"c{k}") for k in range(4)], "date date, code string")
    w = 0.5 ** (np.arange(29, -1, -1) / 20)
    w /= w.sum()
    y = x[-30:] - w @ x[-30:]
    c = (y * w[:, None]).T @ y
    s = 0.7 * c + 0.3 * np.diag(np.diag(c))
    least = np.clip(np.linalg.inv(s) @ np.ones(4) / (np.linalg.inv(s) @ np.ones(4)).sum(), 0, None)
    got = {m: np.array([z["weight"] for z in wt.weights(m, held, ret).orderBy("code").collect()]) for m in wt.METHODS}
    assert np.allclose(got["min_var"], least / least.sum()) and np.allclose(got["equal"], 0.25)
    risk = got["risk_parity"] * (c @ got["risk_parity"])
    assert np.allclose(risk, risk.mean(), rtol=1e-3) and np.isclose(got["risk_parity"].sum(), 1)
    assert np.allclose(got["inverse_vol"], (1 / x[-30:].std(0)) / (1 / x[-30:].std(0)).sum())
    with pytest.raises(ValueError, match="method"):
        wt.weights("best", held, ret)


def test_caps(spark):
    w = spark.createDataFrame([(1, "a", "x", 0.7), (1, "b", "x", 0.1), (1, "c", "y", 0.1), (1, "d", "z", 0.1)], "date int, code string, kind string, weight double")
    one = {r["code"]: r["weight"] for r in wt.capped(w, 0.4).collect()}
    assert np.allclose([one[c] for c in "abcd"], [0.4, 0.2, 0.2, 0.2])
    kinds = {r["kind"]: r["w"] for r in wt.group_capped(w, "kind", 0.4, 30).groupBy("kind").agg(F.sum("weight").alias("w")).collect()}
    assert abs(kinds["x"] - 0.4) < 1e-3 and abs(sum(kinds.values()) - 1) < 1e-9


def test_section_correlations_against_pandas():
    r = np.random.default_rng(1)
    x = r.integers(0, 9, (60, 5)).astype(float)
    x[:10, 1] = x[5:20, 3] = np.nan
    x[:, 4] = 2.0
    names = list("abcde")
    got = {(a, b): (n, rho) for a, b, n, rho in ev.section_correlations(names, x, 30)}
    d = pd.DataFrame(x, columns=names)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = d[[a, b]].dropna().rank(method="min")
            n, rho = got[a, b]
            want = both.corr().iloc[0, 1]
            assert n == len(both) and (rho is None and np.isnan(want) or abs(rho - want) < 1e-12)
    assert ev.section_correlations(names, x, 61) == []


def test_a_calendar_is_worked_out_once(spark, monkeypatch):
    """Two tables of different reach are counted by one calendar."""
    from pyspark.sql import functions as F

    from panelwright.plans import registry

    made = []
    real = registry.dates_by_code
    monkeypatch.setattr(registry, "dates_by_code", lambda rows: made.append(1) or real(rows))
    r = registry.Registry([registry.Table("t"), registry.Table("e", rule="events")])
    r.add(registry.Factor("long", {"t": ("x",)}, column=lambda: F.col("x"), reach=registry.Reach(5, 2)))
    r.register("short", {"t": ("x",), "e": ("x",)}, reach=registry.Reach(2, days=3))(lambda get: get["t"].withColumn("value", F.col("x")))
    t = spark.range(40).select(F.lit("c").alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("x"))
    got = r.pruned(["long", "short"], {"t": t, "e": t}, "2020-01-20", "2020-01-25")
    assert len(made) == 1
    assert [str(got[n].agg(F.min("date")).first()[0]) for n in ("t", "e")] == ["2020-01-13", "2020-01-15"]


def test_replacing_writes_a_table_once_beside_the_folder(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    from panelwright.plans import registry

    written, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(path) or real(self, path, *a, **k))
    f = spark.range(20).select(F.lit("f").alias("factor"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("c").alias("code"), F.col("id").cast("double").alias("value"))
    assert registry.save(f, str(tmp_path / "lake")) == ["f"] and len(written) == 2
    assert registry.save(f.withColumn("value", -F.col("value")), str(tmp_path / "lake"), "merge") == ["f"]
    assert spark.read.parquet(str(tmp_path / "lake")).agg(F.sum("value")).first()[0] == -190.0

"""The rolling model covers every half-year."""

import os

import numpy as np
import pytest

from panelwright.catalog import last
from panelwright.plans import rolling

SF = os.environ.get("PANELWRIGHT_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_half_year_is_predicted(spark):
    half = lambda d: (int(d[:4]), int(d[5:7]) > 6)
    dates = {half(str(r["date"])) for r in last.B(spark, SF).select("date").distinct().collect()}
    got = last.C.queries["ML_03_rolling"](spark, SF).collect()
    first = min(dates)
    assert {half(str(r["date"])) for r in got} == {h for h in dates if h >= (first[0] + 2, first[1])}
    assert all(r["score"] is not None for r in got)


def test_each_window_equals_a_fit_of_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(p, g, *map(float, rng.normal(0, 1, 3))) for p in range(9) for g in ("u", "v") for _ in range(30)]
    rows = [(p, g, a, b, None if i % 7 == 0 else 2 * a - b + (p > 4) * a + 0.1 * e) for i, (p, g, a, b, e) in enumerate(rows)] + [(3, "u", None, 1.0, 5.0), (12, "u", 1.0, 1.0, None), (0, "w", 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "p int, g string, a double, b double, y double")
    got = {(r["p"], r["g"]): r for r in rolling.fits(d, ["a", "b"], "y", "p", 3, by=("g",)).collect()}
    assert set(got) == {(p, g) for p in range(3, 9) for g in "uv"}  # no row of period 12's window has a label
    for (p, g), r in got.items():
        mine = np.array([(1, a, b, y) for q, h, a, b, y in rows if p - 3 <= q < p and h == g and y is not None and a is not None])
        want = np.linalg.lstsq(mine[:, :3], mine[:, 3], rcond=None)[0]
        assert r["n"] == len(mine) and np.allclose([r["intercept"], *r["weights"]], want, atol=1e-9)
    out = rolling.predicted(d, rolling.fits(d, ["a", "b"], "y", "p", 3, by=("g",)), ["a", "b"], "p", ("g",))
    assert out.count() == sum(1 for r in rows if 3 <= r[0] < 9 and r[1] in "uv")
    flat = spark.createDataFrame([(p, 1.0, float(p)) for p in range(6) for _ in range(3)], "p int, a double, y double")
    assert all(abs(r["weights"][0]) < 1e-9 for r in rolling.fits(flat, ["a"], "y", "p", 2).collect())

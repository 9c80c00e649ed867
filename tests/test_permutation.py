"""Shuffles cover every factor."""

import datetime

import numpy as np

from panelwright.catalog import judging


def test_every_factor_has_500_shuffles(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = []
    for day in range(1, 9):
        x, z = r.standard_normal(40), r.standard_normal(40)
        for c in range(40):
            rows += [("strong", datetime.date(2020, 1, day), f"c{c}", float(x[c]), float(x[c] + 0.5 * r.standard_normal())), ("mom_4", datetime.date(2020, 1, day), f"c{c}", float(z[c]), float(x[c]))]
    rows += [("short", datetime.date(2020, 1, 1), f"c{c}", float(c), float(c)) for c in range(29)]
    j = spark.createDataFrame(rows, "factor string, date date, code string, value double, fwd_4 double")
    monkeypatch.setattr(judging, "joined", lambda s, d, h: j)
    got = {x["factor"]: x for x in judging._permuted(spark, "").collect()}
    again = {x["factor"]: x for x in judging._permuted(spark, "").collect()}
    assert set(got) == {"strong", "mom_4"} and got == again
    assert abs(got["strong"]["p"] - 1 / 501) < 1e-12 and got["mom_4"]["p"] > 0.02
    ranks = lambda v: np.argsort(np.argsort(v))
    days = {}
    for f, day, _, a, b in rows:
        if f == "strong":
            days.setdefault(day, []).append((a, b))
    want = np.mean([np.corrcoef(ranks([a for a, _ in v]), ranks([b for _, b in v]))[0, 1] for v in days.values()])
    assert abs(got["strong"]["value"] - want) < 1e-12

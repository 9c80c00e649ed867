"""Jobs of many factors or formulas leave nothing of a step on disk once its result stands."""

import glob
import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.plans import formulas
from panelwright.sources import folders

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    top = spark.conf.get("spark.local.dir", None) or "/tmp"
    return {f for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*") if os.stat(f).st_uid == os.getuid()}


def shared_folders(spark):
    return set(os.listdir(urlparse(folders.shared(spark)).path))


def test_a_table_that_is_written_leaves_no_shuffle(spark, tmp_path):
    import time

    before = shuffle_files(spark)
    out = folders.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "t"))
    for _ in range(50):
        if left := shuffle_files(spark) - before:
            time.sleep(0.1)
    assert out.count() == 7 and not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_formulas_are_summed_up_in_groups(spark, monkeypatch):
    """Narrow groups give what one plan gives, and the panel is gone afterwards."""
    names, sums = ["a101", "a162", "a134", "a167"], {"n": F.count, "value": F.avg}
    made, real = [], formulas.evaluate
    monkeypatch.setattr(formulas, "evaluate", lambda bars, some: made.append(list(some)) or real(bars, some))
    monkeypatch.setattr(formulas, "WIDTH", 4)
    monkeypatch.setattr(formulas, "SMALL", 0)
    with X.nulls_for_errors(spark):
        got = {(r.factor, r.code): r for r in formulas.by_code(X.bars(spark, SF), sums, names).where("n > 0").collect()}
        monkeypatch.undo()
        want = formulas.batch(X.bars(spark, SF), names).groupBy("factor", "code").agg(F.count("value").alias("n"), F.avg("value").alias("value")).collect()
    assert len(made) > 1 and sorted(sum(made, [])) == sorted(names)
    assert len(got) == len(want) > 20
    for r in want:
        assert got[r.factor, r.code].n == r.n and abs(got[r.factor, r.code].value - r.value) <= 1e-12 * max(1, abs(r.value))
    at = urlparse(folders.shared(spark)).path
    assert not [d for d in shared_folders(spark) if d.startswith("formulas-") and os.path.exists(f"{at}/{d}/panel")]


def test_groups_of_formulas_are_bounded():
    lib = formulas.library()
    some = formulas.grouped(lib)
    assert sorted(k for g in some for k in g) == sorted(lib)
    assert all(len(g) == 1 or len(g) <= formulas.TOGETHER and formulas.carried(list(g.values())) <= formulas.WIDTH for g in some)


def test_factors_are_worked_out_by_parts(spark, monkeypatch):
    """Values by parts equal those of one plan, a frame goes after its last reader and the tables after the block."""
    from panelwright.catalog.named import Inputs
    from panelwright.plans import registry
    from panelwright.plans.library import LIBRARY

    names = ["momentum_20", "reversal_5", "volatility_20", "team_coin_20", "boat_follow_20", "ep", "bp", "epd_60"]
    monkeypatch.setattr(registry, "PART", 2)
    seen, real = [], LIBRARY._side_by_side
    at = urlparse(folders.shared(spark)).path
    parts = lambda: {n for d in shared_folders(spark) if d.startswith("parts-") and d not in before for n in os.listdir(f"{at}/{d}")}
    before = shared_folders(spark)
    monkeypatch.setattr(LIBRARY, "_side_by_side", lambda some, *a: seen.append((tuple(some), parts())) or real(some, *a))
    then = lambda f: f.groupBy("factor").agg(F.count("*").alias("n"), F.count("value").alias("k"), F.avg("value").alias("value"))
    with X.nulls_for_errors(spark):
        with LIBRARY.kept(names, Inputs(spark, SF)) as t:
            got = {r.factor: r for r in LIBRARY.each(names, t, then).collect()}
        want = {r.factor: r for r in then(LIBRARY.compute(names, Inputs(spark, SF))).collect()}
    seen = seen[:7]  # the rest are of the one plan
    assert sorted(n for some, _ in seen for n in some) == sorted(names) and all(len(some) <= 2 for some, _ in seen)
    held = dict(seen)
    assert "priced" in held["momentum_20", "reversal_5"] and "priced" not in held["ep",] and "capitalised" not in held["team_coin_20",]
    assert not {n for n in parts() if not n.startswith("part-")}
    assert not [d for d in shared_folders(spark) - before if d.startswith("tables-")]
    assert got.keys() == want.keys() == set(names)
    for n in names:
        assert (got[n].n, got[n].k) == (want[n].n, want[n].k) and (want[n].value is None or abs(got[n].value - want[n].value) <= 1e-9 * max(1, abs(want[n].value)))


def test_replays_leave_their_result_alone(spark):
    from panelwright.catalog import audits

    before = shared_folders(spark)
    with X.nulls_for_errors(spark):
        out = audits._replayed(spark, SF, ["momentum_20", "leak_next", "leak_high"])
    at = urlparse(folders.shared(spark)).path
    new = {f"{d}/{n}" for d in shared_folders(spark) - before for n in os.listdir(f"{at}/{d}")}
    assert out.count() == 6 and all("/part-" in n or n.startswith("calendar-") for n in new), new


def test_the_panel_is_read_twice_where_it_stands(spark):
    """The market's mean return by date equals that of a window over whole rows, and no window across dates is planned."""
    from panelwright.catalog.named import Inputs
    from panelwright.plans.library import LIBRARY
    from panelwright.plans.registry import Inputs as Frames

    with X.nulls_for_errors(spark):
        plain, staged = (Frames({n: Inputs(spark, SF)[n] for n in ("bars", "flow", "flows", "capital")}, LIBRARY.frames) for _ in range(2))
        staged.made["moved"] = folders.written(staged["moved"], folders.fresh(spark, "moved"))
        staged.written.add("moved")
        want = {(r.code, r.date): r for r in plain["panel"].collect()}
        got = staged["panel"]
        assert "windowspecdefinition(date" not in got._jdf.queryExecution().analyzed().toString() and set(got.columns) == set(plain["panel"].columns)
        rows = got.collect()
    assert len(rows) == len(want) > 2000
    for r in rows:
        w = want[r.code, r.date]
        assert all(r[n] == w[n] for n in ("close", "main_net", "small_net", "ret", "turnover")) and (r.mkt is None) == (w.mkt is None) and (r.mkt is None or abs(r.mkt - w.mkt) < 1e-12)

"""Registered queries against DuckDB on the smallest tables, and what happens without the optional parts."""

import importlib
import math
import os
import sys

import pytest

SF = os.environ.get("PANELWRIGHT_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["TS_07_rank", "TS_12_slope", "TS_22_held_cost", "TS_28_cooled_down", "XS_05_winsorize", "XS_09_neutralize", "PNL_03_dense", "JN_04_asof", "JN_07_interval", "JN_10_triangular", "SNK_02_append_years", "AG_13_rollup", "TK_08_buffer", "PIT_03_suppression", "CA_01_adjustment", "MIN_01_day_features", "SS_01_tumbling", "FA_03_rsi_14", "FA_29_roe_ttm", "FA_36_sue_i", "FA_38_gpoa_chg", "UX_01_registered", "PF_21_weekday", "SS_04_last_value", "CA_04_taxed"]


def rows(df):
    def plain(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    from panelwright import catalog

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and len(a) > 0
    assert all(p == q or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(p, q)) for p, q in zip(a, b))


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("__spark_entry__", "corpus_pipeline", "panelwright.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.util.find_spec

    def spec(name, *a):
        if name.startswith("panelwright.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib.util, "find_spec", spec)
    entry = importlib.import_module("__spark_entry__")
    assert entry.LLM is None and entry.PIPELINE is None
    assert "EV_01_rank_ic" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_names_are_unique():
    from panelwright.catalog.fixtures import Catalog

    c = Catalog()
    c.add("x", None)
    with pytest.raises(ValueError):
        c.add("x", None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ranks_side_by_side_equal_those_of_the_long_table_without_its_exchange(spark):
    from pyspark.sql import functions as F

    from panelwright.catalog import judging
    from panelwright.operators import xs

    names = ["mom_4", "size", "vol_12"]
    long = judging.factors(spark, SF).withColumn("r", xs.rank_pct("value", ("factor", "date"))).groupBy("date", "code").pivot("factor", names).agg(F.max("r")).na.drop()
    got = judging.features(spark, SF)
    assert got.count() > 0 and got.exceptAll(long).count() == long.exceptAll(got).count() == 0
    plan = judging.C.queries["ML_01_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan

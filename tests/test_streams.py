"""Replayed streams are tables of files, not rows in the driver."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelwright.sources.tables import upsert
from panelwright.streaming import bars


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, datetime.datetime(2020, 1, 1, 0, i % 60), i % 7, f"e{i % 3}", float(i)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, f"r{i}") for i in range(5)], "r_regionkey long, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    return str(tmp_path)


def test_results_are_files(spark, folder):
    once = bars.source(spark, folder).select("event_id")
    kept = bars.replayed(once, "append")
    assert kept.count() == 300 and kept.inputFiles()
    whole = bars.replayed(bars.tumbling_bars(bars.source(spark, folder)))
    assert whole.count() == 36 and whole.inputFiles()
    assert {r["code"]: r["n"] for r in bars.deduplicated(spark, folder).collect()} == {"e0": 100, "e1": 100, "e2": 100}
    assert sum(r["n"] for r in bars.enriched(spark, folder).collect()) == 300
    assert bars.replayed(once.where("event_id < 0"), "append").count() == 0
    assert bars.replayed(once.where("event_id < 0").groupBy("event_id").count()).count() == 0


def some_events(spark, n=400):
    rows = [(i, datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=i), i % 7, ("view", "purchase", "other")[i % 3], float(i % 50)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


def bars_of(df):
    return sorted((r["code"], r["start"], r["high"], r["low"], r["vol"]) for r in df.collect())


def test_a_stream_in_parts_that_come_in_order_equals_the_batch(spark):
    e = some_events(spark)
    half = F.when(F.col("event_id") < 200, 0).otherwise(1)
    got = bars.replayed(bars.tumbling_bars(bars.arrivals(spark, e, half, 2)), "append").where(f"code <> '{bars.CLOSING}'")
    batch = e.groupBy(F.window("ts", "5 minutes"), F.col("event_type").alias("code")).agg(F.max("value").alias("high"), F.min("value").alias("low"), (F.count("*") + F.sum(F.col("user_id") % 7)).cast("double").alias("vol"))
    assert bars_of(got) == bars_of(batch.select("code", F.col("window.start").alias("start"), "high", "low", "vol"))


def test_rows_that_come_after_their_bar_has_ended_are_left_out(spark):
    e = some_events(spark)
    late = F.when(F.col("event_id") == 7, 3).otherwise(F.floor(F.col("event_id") / 150))
    got = bars.replayed(bars.tumbling_bars(bars.arrivals(spark, e, late, 4)), "append").where(f"code <> '{bars.CLOSING}'")
    all_ = e.where("event_id <> 7")
    assert sum(r["vol"] for r in got.collect()) == sum(1 + r["user_id"] % 7 for r in all_.collect())


def test_a_batch_that_comes_again_or_late_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "stored")
    first = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 2, 2.0, "x"), ("c", 3, 3.0, "y")], "code string, k int, v double, part string")
    second = spark.createDataFrame([("a", 1, 9.0, "x"), ("d", 4, 4.0, "x"), ("d", 4, 5.0, "x")], "code string, k int, v double, part string")

    def stored():
        return {(r["code"], r["k"]): r["v"] for r in spark.read.parquet(folder).collect()}

    upsert(spark, folder, first, ["code", "k"], "part", 0)
    untouched = {f for f in spark.read.parquet(folder).inputFiles() if "part=y" in f}
    upsert(spark, folder, second, ["code", "k"], "part", 1)
    want = {("a", 1): 9.0, ("b", 2): 2.0, ("c", 3): 3.0, ("d", 4): 5.0}
    assert stored() == want
    upsert(spark, folder, second, ["code", "k"], "part", 1)
    upsert(spark, folder, first, ["code", "k"], "part", 0)  # an older batch doesn't undo a newer one
    upsert(spark, folder, first.limit(0), ["code", "k"], "part", 2)
    assert stored() == want
    upsert(spark, folder, second.where("code = 'a'").withColumn("v", F.lit(10.0)), ["code", "k"], "part", 3)
    assert stored() == want | {("a", 1): 10.0}
    upsert(spark, str(tmp_path / "other"), second.limit(0), ["code", "k"], "part", 0)
    again = {f for f in spark.read.parquet(folder).inputFiles() if "part=y" in f}
    assert len(untouched) == len(again) == 1


def test_a_stream_delivered_twice_is_stored_once(spark, tmp_path):
    e = some_events(spark, 90).withColumn("day", F.to_date("ts"))
    s = bars.arrivals(spark, e, F.col("event_id") % 3, 3).where(f"event_type <> '{bars.CLOSING}'")
    for _ in range(2):
        bars.upserted(s, str(tmp_path / "t"), ["event_id"], "day")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 90


def test_a_view_that_arrives_after_a_later_purchase_still_counts(spark):
    at = datetime.datetime(2020, 1, 1)
    minute = lambda m: at + datetime.timedelta(minutes=m)
    rows = [(1, minute(0), 1, "view", 10.0, 0), (2, minute(5), 1, "purchase", 0.0, 0), (3, minute(4), 1, "view", 20.0, 1), (4, minute(6), 2, "purchase", 0.0, 1), (5, minute(50), 1, "purchase", 0.0, 1), (6, minute(200), 1, "view", 30.0, 2), (7, minute(7), 1, "view", 99.0, 3)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, part int")
    got = {r["event_id"]: r["value"] for r in bars.settled_values(spark, e, F.col("part"), 4).collect()}
    assert got == {2: 20.0, 4: None, 5: 20.0}  # the last view is later than the watermark lets in


class _State:
    """The parts of the streaming handle that last_values() uses, in memory; counts timers."""

    def __init__(self):
        self.timers, self.value, self.rows = [], None, []

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return self

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class _Waiting(_State):
    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.rows += rows

    put = lambda self, rows: setattr(self, "rows", list(rows))

    def clear(self):
        self.rows = []


def test_timers_do_not_grow_with_the_rows_of_a_user():
    import pandas as pd

    handle, waiting, p = _State(), _Waiting(), bars._LastValue()
    p.init(handle)
    p.waiting = waiting
    n = 500
    d = pd.DataFrame({"event_id": range(n), "event_type": ["view", "purchase"] * (n // 2), "ts": pd.to_datetime("2020-01-01") + pd.to_timedelta(range(n), unit="min"), "value": [float(i) for i in range(n)]})
    list(p.handleInputRows(("1",), iter([d[: n // 2], d[n // 2 :]]), None))
    assert len(handle.timers) == 1
    handle.mark = int(pd.Timestamp("2020-01-01 01:00").value // 1_000_000)
    out = pd.concat(p.handleExpiredTimer(("1",), handle, None))
    assert out["event_id"].tolist() == list(range(1, 60, 2)) and out["value"].tolist() == [float(i) for i in range(0, 60, 2)]
    assert len(handle.timers) == 2 and len(waiting.rows) == n - 60 and handle.timers[-1] == handle.mark + 1
    handle.mark = int(pd.Timestamp("2020-02-01").value // 1_000_000)
    assert len(pd.concat(p.handleExpiredTimer(("1",), handle, None))) == n // 2 - 30 and not waiting.rows and len(handle.timers) == 2
    assert not list(p.handleExpiredTimer(("1",), handle, None))

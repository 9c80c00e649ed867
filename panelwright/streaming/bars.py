"""Structured Streaming forms of the bar operators.

Each takes a directory of event files as a stream and, for replays, runs it to its end with AvailableNow.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.folders import exists, fresh
from panelwright.sources.tables import upsert


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; the path must be a folder or a glob of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def replayed(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result after all that is there now, as a Parquet table in the shared folder; no row passes through the driver."""
    spark = stream.sparkSession
    base = fresh(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{base}/rows")
    else:  # each batch is the whole result, which takes the place of the one before
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows"))
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows") if exists(spark, f"{base}/rows") else spark.createDataFrame([], stream.schema)


def tumbling_bars(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("code"))
    return w.agg(F.max("value").alias("high"), F.min("value").alias("low"), (F.count("*") + F.sum(F.col("user_id") % 7)).cast("double").alias("vol")).select("code", F.col("window.start").alias("start"), "high", "low", "vol")


def sliding_variance(events: DataFrame, width: str = "30 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), F.col("event_type").alias("code"))
    return w.agg(F.count("*").alias("n"), F.var_samp("value").alias("variance")).select("code", F.col("window.start").alias("start"), "n", "variance")


#: An event of this type carries no data: it closes a replay, as its time lies beyond what any window waits for.
CLOSING = "closing"


def arrivals(spark: SparkSession, events: DataFrame, part, parts: int, beyond: str = "2 days") -> DataFrame:
    """A stream of the events in the order in which their parts (0 to parts - 1) arrive, a file and batch each, and one that closes it.

    The parts are written to the shared folder one after the other. The closing event moves the watermark past
    the last window, so that in append mode every window ends and no state is left.
    """
    folder = f"{fresh(spark, 'arrivals')}/rows"
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(parts):
        events.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {beyond}")).alias("ts"), F.lit(CLOSING).alias("event_type"))
    last = end.select(*[F.col(f.name) if f.name in ("ts", "event_type") else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    last.where("ts is not null").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars as they end; start as text. Three parts by time arrive in order, and of each one event in 97 two parts late: those whose bar has ended by then are left out."""
    return appended_bars(spark, spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def by_day(events: DataFrame) -> tuple:
    """(the part that an event arrives in, number of parts): thirds by the day of the month, and one event in 97 two parts later.

    A batch still takes what the watermark of the batch before let in, so one part later would be in time.
    """
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + F.when(F.col("event_id") % 97 == 0, 2).otherwise(0)
    return third.cast("int"), 5


def appended_bars(spark: SparkSession, events: DataFrame) -> DataFrame:
    return replayed(tumbling_bars(arrivals(spark, events, *by_day(events))), "append").where(f"code <> '{CLOSING}'")


def appended_variance(spark: SparkSession, events: DataFrame) -> DataFrame:
    return replayed(sliding_variance(arrivals(spark, events, *by_day(events))), "append").where(f"code <> '{CLOSING}'")


def upserted(stream: DataFrame, folder: str, keys: list[str], by: str) -> None:
    """Run the stream to its end; each batch is merged into the stored table, see tables.upsert()."""
    spark = stream.sparkSession
    write = stream.writeStream.option("checkpointLocation", f"{fresh(spark, 'stream')}/checkpoint").trigger(availableNow=True)
    write.foreachBatch(lambda batch, number: upsert(spark, folder, batch, keys, by, number)).start().awaitTermination()


def revised(spark: SparkSession, sf_dir: str, times: int = 2) -> DataFrame:
    """Bars of a minute that come in two parts: all of them, then one in ten again with its close raised by 1. The whole stream is delivered `times` times into one stored table."""
    m = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.date_trunc("minute", F.col("ts").cast("timestamp")))
    m = m.groupBy("event_type", "ts").agg(F.round(F.avg("value"), 6).alias("close"), F.count("*").alias("n"))
    again = (F.minute("ts") % 10 == 3) & (F.hour("ts") % 2 == 0)
    both = m.withColumn("part", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.withColumn("close", F.col("close") + F.col("part"))
    bars = arrivals(spark, both, F.col("part"), 2).where("part is not null").withColumn("day", F.to_date("ts"))
    folder = fresh(spark, "bars")
    for _ in range(times):
        upserted(bars.select("event_type", "ts", "close", "n", "day"), folder, ["event_type", "ts"], "day")
    return spark.read.parquet(folder)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the region that its user belongs to, counted."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    s = source(spark, sf_dir).withColumn("r_regionkey", F.col("user_id") % 5).join(F.broadcast(region), "r_regionkey")
    return replayed(s.groupBy(F.col("event_type").alias("code"), F.col("r_name").alias("region")).agg(F.count("*").alias("n")))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent twice count once."""
    twice = source(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = twice.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    return replayed(once.select(F.col("event_type").alias("code"), "event_id"), "append").groupBy("code").agg(F.count("*").alias("n"))


class _LastValue:
    """Made a StatefulProcessor where it is used, so that this module loads without the streaming classes."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, value double")
        self.waiting = handle.getListState("waiting", "event_id long, event_type string, ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        first = None
        for d in rows:
            self.waiting.appendList(list(d[["event_id", "event_type", "ts", "value"]].itertuples(index=False, name=None)))
            ts = d["ts"].min()
            first = ts if first is None else min(first, ts)
        if first is not None:
            self.handle.registerTimer(pd.Timestamp(first).value // 1_000_000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """What has a time before the watermark is complete, as no earlier row is let in any more: all of it goes at the first timer that the watermark passes; what still waits gets a timer for its first row."""
        import pandas as pd

        rows = list(self.waiting.get())
        if not rows:  # gone by an earlier timer
            return
        until = timerValues.getCurrentWatermarkInMs()
        rows.sort(key=lambda r: (r[2], r[1] != "view", r[0]))
        at = [pd.Timestamp(r[2]).value // 1_000_000 for r in rows]
        due = rows[: bisect.bisect_left(at, until)]
        if len(due) < len(rows):
            self.handle.registerTimer(at[len(due)] + 1)
        if not due:
            return
        known = self.last.get() if self.last.exists() else None
        out = []
        for event, kind, ts, value in due:
            if kind == "view":
                known = (ts, value)
            else:
                out.append((event, str(key[0]), None if known is None else known[1]))
        if known is not None:
            self.last.update(tuple(known))
        if len(due) < len(rows):
            self.waiting.put(rows[len(due) :])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["event_id", "code", "value"]).astype({"event_id": "int64"})

    def close(self) -> None:
        pass


def last_values(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each purchase with the value of its user's last view at or before it: an as-of join of one stream's two kinds, with the last view of a user as state.

    Rows wait in the state until the watermark has passed them (a timer for a user's first one), so a
    view that arrives a batch later than a purchase after it still counts, as long as it is not later than
    `late`; rows later than that are left out. State is one row a user and the rows of the last `late`, in the
    RocksDB store, which the session must name as its state store provider when the query starts.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class LastValue(_LastValue, StatefulProcessor):
        pass

    some = events.where(f"event_type in ('view', 'purchase', '{CLOSING}')").withWatermark("ts", late)
    some = some.select(F.coalesce(F.col("user_id").cast("string"), F.lit(CLOSING)).alias("code"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "event_type", "ts", "value")
    done = some.groupBy("code").transformWithStateInPandas(statefulProcessor=LastValue(), outputStructType="event_id long, code string, value double", outputMode="Append", timeMode="EventTime")
    return done.where("event_id >= 0")


STORE = "spark.sql.streaming.stateStore.providerClass"


def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three parts by time; one in 97 arrives two parts later, and counts unless the watermark has passed it by then."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('view', 'purchase')")
    return settled_values(spark, e, *by_day(e))


def settled_values(spark: SparkSession, events: DataFrame, part, parts: int) -> DataFrame:
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return replayed(last_values(arrivals(spark, events, part, parts)), "append")
    finally:
        spark.conf.set(STORE, before)

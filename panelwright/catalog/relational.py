"""Sources and sinks, joins, aggregates, windows, selections and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.functions.elementwise import finite
from panelwright.operators import asof, panel, ts
from panelwright.plans import fundamentals
from panelwright.sources import tables as src
from panelwright.sources.folders import fresh

C = X.Catalog()
B = X.bars


def _folder(spark) -> str:
    return fresh(spark, "tables")


def _written(s, d):
    """Weekly bars stored by year, and the folder."""
    folder = f"{_folder(s)}/bars"
    src.write_partitioned(B(s, d).withColumn("year", F.year("date")), folder, ["year"])
    return folder


# Sources and sinks
C.add("SRC_01_scan", lambda s, d: src.scan(s, _written(s, d), "1997-01-01", "1998-12-31").select("code", "date", "close"), "SELECT code, date, close FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", values=("close",))


def _factor_table(s, d):
    b = B(s, d)
    f = b.select("date", "code", F.explode(F.create_map(F.lit("close"), F.col("close"), F.lit("vol"), F.col("vol"))).alias("factor", "score")).withColumn("year", F.year("date"))
    folder = f"{_folder(s)}/factors"
    src.write_partitioned(f, folder, ["factor", "year"])
    return folder


C.add("SRC_02_factor", lambda s, d: src.read_factor(s, _factor_table(s, d), ["vol"], "1997-01-01", "1997-12-31"), "SELECT date, code, 'vol' AS factor, vol AS value FROM bars WHERE year(date) = 1997")


def _tolerant(s, d):
    base = _folder(s)
    b = B(s, d)
    b.where("year(date) = 1996").select("code", "date", "close").write.parquet(f"{base}/a")
    b.where("year(date) = 1997").select("code", "date", "vol").write.parquet(f"{base}/b")
    return src.scan_tolerant(s, f"{base}/a", f"{base}/b").select("code", "date", "close", "vol")


C.add("SRC_03_tolerant", _tolerant, "SELECT code, date, CASE WHEN year(date) = 1996 THEN close END AS close, CASE WHEN year(date) = 1997 THEN vol END AS vol FROM bars WHERE year(date) IN (1996, 1997)", values=("close", "vol"))
C.add("SRC_04_pruned", lambda s, d: src.scan(s, _written(s, d), "1999", on="year").groupBy("year").agg(F.count("*").alias("n")), "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM bars WHERE year(date) >= 1999 GROUP BY 1", dates=(), values=())


def _replaced(s, d):
    folder = _written(s, d)
    src.write_partitioned(B(s, d).where("year(date) = 1997 and vol > 50").withColumn("year", F.year("date")), folder, ["year"])
    return s.read.parquet(folder).groupBy("year").agg(F.count("*").alias("n"))


_REPLACED = "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM bars WHERE year(date) <> 1997 OR vol > 50 GROUP BY 1"
C.add("SRC_05_partition_write", _replaced, _REPLACED, dates=(), values=())
C.add("SNK_03_year_replace", _replaced, _REPLACED, dates=(), values=())


def _upsert(s, d):
    b = B(s, d).select("code", "date", "close")
    new = b.where("code = '1'").withColumn("close", F.col("close") * 2)
    return src.upserted(b, new, ["code", "date"])


C.add("SNK_01_upsert", _upsert, "SELECT code, date, CASE WHEN code = '1' THEN close * 2 ELSE close END AS close FROM bars", values=("close",))


def _stored(s, d):
    """Bars stored by year, corrected by a second batch; then the second and the first are delivered again."""
    folder = fresh(s, "upserted")
    b = B(s, d).select("code", "date", "close").withColumn("year", F.year("date"))
    better = b.where("date >= '1997-01-01' and code in ('1', '2')").withColumn("close", F.col("close") + 1)
    more = better.where("code = '1'").withColumn("code", F.lit("new"))
    batches = [b, better.unionByName(more)]
    for i in (0, 1, 1, 0):
        src.upsert(s, folder, batches[i], ["code", "date"], "year", i)
    return s.read.parquet(folder).select("code", "date", F.col("close").alias("value"))


C.add("SNK_01_stored", _stored, """n AS (SELECT code, date, close + 1 AS value FROM bars WHERE date >= DATE '1997-01-01' AND code IN ('1', '2'))
SELECT code, date, close AS value FROM bars ANTI JOIN n USING (code, date) UNION ALL SELECT code, date, value FROM n UNION ALL SELECT 'new', date, value FROM n WHERE code = '1'""")


def _append(s, d):
    folder = _written(s, d)
    new = B(s, d).where("year(date) = 1998").withColumns({"year": F.year("date"), "close": F.col("close") + 1})
    src.append_years(s, folder, new, ["code", "date"])
    return s.read.parquet(folder).groupBy("year").agg(F.count("*").alias("n"), F.sum("close").alias("value"))


C.add("SNK_02_append_years", _append, "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, sum(close) + CASE WHEN year(date) = 1998 THEN count(*) ELSE 0 END AS value FROM bars GROUP BY year(date)", dates=(), digits=2)
C.add("SNK_04_window_merge", lambda s, d: src.window_merge(B(s, d).select("code", "date", "close"), B(s, d).select("code", "date", (F.col("close") / 2).alias("close")), "1999-01-01"), "SELECT code, date, CASE WHEN date < DATE '1999-01-01' THEN close ELSE close / 2 END AS close FROM bars", values=("close",))


def _adhoc(s, d):
    B(s, d).createOrReplaceTempView("panelwright_bars")
    return s.sql("SELECT code, count(*) AS n, max(close) AS value FROM panelwright_bars WHERE vol > 20 GROUP BY code")


C.add("SNK_05_sql", _adhoc, "SELECT code, count(*) AS n, max(close) AS value FROM bars WHERE vol > 20 GROUP BY code", dates=())

# Joins
C.add("JN_01_inner", lambda s, d: B(s, d).join(X.flow(s, d), ["date", "code"]).select("date", "code", (F.col("main_net") / F.col("amount")).alias("value")), "SELECT date, code, main_net / amount AS value FROM bars JOIN flow USING (date, code)")
C.add("JN_02_left", lambda s, d: B(s, d).join(X.groups(s, d).where("coarse <> '0'"), "code", "left").select("date", "code", "fine", "shares"), "SELECT date, code, fine, shares FROM bars LEFT JOIN (SELECT * FROM groups WHERE coarse <> '0') USING (code)", values=())
C.add("JN_03_full", lambda s, d: B(s, d).groupBy("date").agg(F.count("*").alias("n")).join(X.actions(s, d).groupBy("date").agg(F.count("*").alias("m")), "date", "full"), "SELECT date, n, m FROM (SELECT date, count(*) AS n FROM bars GROUP BY date) FULL JOIN (SELECT date, count(*) AS m FROM actions GROUP BY date) USING (date)", values=())


def _ladder(s, d):
    """One row a publication date: the latest period."""
    return panel.latest(X.reports(s, d), ["code", "notice"], [F.desc("period")])


_LADDER = "ladder AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY code, notice ORDER BY period DESC) = 1)"
C.add("JN_04_asof", lambda s, d: asof.asof(B(s, d).select("code", "date"), _ladder(s, d), ["period", "net_profit"], right_on="notice"), f"{_LADDER}\nSELECT bars.code, bars.date, period, net_profit FROM bars ASOF LEFT JOIN ladder ON bars.code = ladder.code AND bars.date >= ladder.notice", dates=("date", "period"), values=("net_profit",))
C.add("JN_05_asof_fresh", lambda s, d: asof.asof(B(s, d).select("code", "date"), _ladder(s, d), ["net_profit"], right_on="notice", within_days=60), f"{_LADDER}\nSELECT bars.code, bars.date, CASE WHEN date_diff('day', notice, bars.date) <= 60 THEN net_profit END AS net_profit FROM bars ASOF LEFT JOIN ladder ON bars.code = ladder.code AND bars.date >= ladder.notice", values=("net_profit",))


def _chained(s, d):
    known = asof.asof(X.actions(s, d), _ladder(s, d), ["net_profit"], right_on="notice")
    priced = asof.asof(known, B(s, d).select("code", "date", "close"), ["close"], strict=True)
    return priced.select("code", "date", "cash", "net_profit", "close")


C.add("JN_06_asof_chained", _chained, f"""{_LADDER},
k AS (SELECT a.code, a.date, a.cash, l.net_profit FROM actions a ASOF LEFT JOIN ladder l ON a.code = l.code AND a.date >= l.notice)
SELECT k.code, k.date, k.cash, k.net_profit, b.close FROM k ASOF LEFT JOIN bars b ON k.code = b.code AND k.date > b.date""", values=("cash", "net_profit", "close"))
C.add("JN_07_interval", lambda s, d: asof.in_windows(B(s, d).select("code", "date"), X.actions(s, d), -19, 0, "cash", "value"), "SELECT b.code, b.date, coalesce(sum(a.cash), 0) AS value FROM bars b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date - 19 AND b.date GROUP BY 1, 2")
C.add("JN_08_forward_interval", lambda s, d: asof.in_windows(B(s, d).select("code", "date"), X.actions(s, d), 0, 60, "cash", "value"), "SELECT b.code, b.date, coalesce(sum(a.cash), 0) AS value FROM bars b LEFT JOIN actions a ON a.code = b.code AND a.date BETWEEN b.date AND b.date + 60 GROUP BY 1, 2")


def _year_before(s, d):
    r = X.reports(s, d).select("code", "period", "revenue")
    before = r.select("code", F.last_day(F.add_months("period", 12)).alias("period"), F.col("revenue").alias("before"))
    return r.join(before, ["code", "period"]).select("code", "period", (F.col("revenue") / F.col("before") - 1).alias("value"))


C.add("JN_09_period_offset", _year_before, "SELECT a.code, a.period, a.revenue / b.revenue - 1 AS value FROM reports a JOIN reports b ON a.code = b.code AND a.period = last_day(b.period + INTERVAL 12 MONTH)", dates=("period",))


def _triangular(s, d):
    """Mean profit of the four latest earlier periods that were out by a report's own publication: one ordered pass along the code, no self-join."""
    r = fundamentals.published_before(X.reports(s, d).withColumn("q", F.year("period") * 4 + F.quarter("period")), "net_profit", 4).where(F.size("_before") > 0)
    return r.select("code", "period", F.size("_before").cast("long").alias("n"), (F.aggregate("_before", F.lit(0.0), lambda a, e: a + e["v"]) / F.size("_before")).alias("value"))


C.add("JN_10_triangular", _triangular, """j AS (SELECT c.code, c.period, p.net_profit FROM reports c JOIN reports p ON p.code = c.code AND p.period < c.period AND p.notice <= c.notice QUALIFY row_number() OVER (PARTITION BY c.code, c.period ORDER BY p.period DESC) <= 4)
SELECT code, period, count(*) AS n, avg(net_profit) AS value FROM j GROUP BY 1, 2""", dates=("period",), digits=2)


def _monthly_members(s, d):
    """Per month the half of codes with the most amount, named by the month's first day."""
    m = B(s, d).groupBy(F.trunc("date", "month").alias("period"), "code").agg(F.sum("amount").alias("a"))
    w = Window.partitionBy("period").orderBy(F.desc("a"), "code")
    return m.withColumn("r", F.percent_rank().over(w)).where("r <= 0.5").select("period", "code")


_MEMBERS = "members AS (SELECT period, code FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS period, code, sum(amount) AS a FROM bars GROUP BY 1, 2) QUALIFY percent_rank() OVER (PARTITION BY period ORDER BY a DESC, code) <= 0.5)"


def _pit_members(s, d):
    m = _monthly_members(s, d).withColumn("period", F.add_months("period", 1)).where("month(period) in (1, 4, 7, 10)")
    dates = B(s, d).select("date").distinct().withColumn("k", F.lit(1))
    at = asof.asof(dates, m.select("period").distinct().withColumn("k", F.lit(1)), ["period"], by="k", right_on="period")
    return at.where("period is not null").join(m, "period").select("date", "code", "period")


C.add("JN_11_pit_members", _pit_members, f"""{_MEMBERS},
m AS (SELECT CAST(period + INTERVAL 1 MONTH AS DATE) AS period, code FROM members WHERE month(period + INTERVAL 1 MONTH) IN (1, 4, 7, 10)),
a AS (SELECT date, (SELECT max(period) FROM m WHERE m.period <= d.date) AS period FROM (SELECT DISTINCT date FROM bars) d)
SELECT date, code, a.period FROM a JOIN m ON m.period = a.period""", dates=("date", "period"), values=())
C.add("JN_12_anti", lambda s, d: B(s, d).join(X.actions(s, d), ["code", "date"], "left_anti").select("code", "date"), "SELECT code, date FROM bars ANTI JOIN actions USING (code, date)", values=())
C.add("JN_13_semi", lambda s, d: B(s, d).join(X.actions(s, d), ["code", "date"], "left_semi").select("code", "date"), "SELECT code, date FROM bars SEMI JOIN actions USING (code, date)", values=())


def _market(s, d):
    b = panel.returns(B(s, d))
    m = b.groupBy("date").agg(F.avg("ret").alias("m"))
    return b.join(m, "date").select("code", "date", (F.col("ret") - F.col("m")).alias("value"))


C.add("JN_14_day_level", _market, """r AS (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars)
SELECT code, date, ret - avg(ret) OVER (PARTITION BY date) AS value FROM r""")


def _near(s, d):
    a = X.actions(s, d).select("code", "date")
    reach = a.select("code", F.explode(F.array(*[F.date_add("date", k) for k in (-7, 0, 7)])).alias("date"))
    return B(s, d).join(reach, ["code", "date"], "left_semi").select("code", "date")


C.add("JN_15_tolerance", _near, "SELECT code, date FROM bars b WHERE EXISTS (SELECT 1 FROM actions a WHERE a.code = b.code AND a.date IN (b.date - 7, b.date, b.date + 7))", values=())
C.add("JN_16_next_calendar", lambda s, d: X.actions(s, d).join(panel.calendar(B(s, d)).select(F.col("trade_date").alias("date"), "next"), "date").where("next is not null").select("code", "next", "cash"), "SELECT code, next, cash FROM actions JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM bars)) USING (date) WHERE next IS NOT NULL", dates=("next",), values=("cash",))

# Aggregates
C.add("AG_01_group", lambda s, d: B(s, d).groupBy("code").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"), F.avg("close").alias("value"), F.min("low").alias("low"), F.max("high").alias("high")), "SELECT code, count(*) AS n, sum(vol) AS vol, avg(close) AS value, min(low) AS low, max(high) AS high FROM bars GROUP BY code", dates=(), values=("value", "low", "high"))
C.add("AG_02_filtered", lambda s, d: B(s, d).groupBy("date").agg(F.avg(F.when(F.col("vol") > 50, F.col("close"))).alias("value")), "SELECT date, avg(close) FILTER (WHERE vol > 50) AS value FROM bars GROUP BY date")
C.add("AG_03_having", lambda s, d: B(s, d).groupBy("date").agg(F.count("*").alias("n")).where("n >= 80"), "SELECT date, count(*) AS n FROM bars GROUP BY date HAVING count(*) >= 80", values=())
C.add("AG_04_distinct", lambda s, d: B(s, d).groupBy(F.year("date").alias("year")).agg(F.countDistinct("code").alias("codes"), F.countDistinct("date").alias("dates")), "SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT code) AS codes, count(DISTINCT date) AS dates FROM bars GROUP BY 1", dates=(), values=())
C.add("AG_05_corr", lambda s, d: B(s, d).groupBy("date").agg(F.when(F.count("*") >= 3, finite(F.corr("close", "vol"))).alias("value")), "SELECT date, CASE WHEN count(*) >= 3 THEN corr(close, vol) END AS value FROM bars GROUP BY date")
C.add("AG_06_quantiles", lambda s, d: B(s, d).groupBy("date").agg(*[F.percentile("close", F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.99)]), "SELECT date, quantile_cont(close, 0.01) AS q1, quantile_cont(close, 0.5) AS q50, quantile_cont(close, 0.99) AS q99 FROM bars GROUP BY date", values=("q1", "q50", "q99"))
C.add("AG_07_arg_max", lambda s, d: X.minutes(s, d).groupBy("code", "date").agg(F.max_by("close", F.when(F.hour("datetime") < 6, F.col("datetime"))).alias("value")), "SELECT code, date, arg_max(close, CASE WHEN hour(datetime) < 6 THEN datetime END) AS value FROM minutes GROUP BY 1, 2")
C.add("AG_08_first_last", lambda s, d: X.minutes(s, d).groupBy("code", "date").agg(F.min_by("open", "datetime").alias("open"), F.max_by("close", "datetime").alias("close")), "SELECT code, date, arg_min(open, datetime) AS open, arg_max(close, datetime) AS close FROM minutes GROUP BY 1, 2", values=("open", "close"))
C.add("AG_09_moments", lambda s, d: panel.returns(B(s, d)).groupBy("code").agg(*[F.sum(F.pow("ret", F.lit(k))).alias(f"m{k}") for k in (2, 3)]), "SELECT code, sum(ret ** 2) AS m2, sum(ret ** 3) AS m3 FROM (SELECT code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars) GROUP BY code", dates=(), values=("m2", "m3"), digits=2)
C.add("AG_10_median", lambda s, d: B(s, d).groupBy("code").agg(F.median("close").alias("value")), "SELECT code, median(close) AS value FROM bars GROUP BY code", dates=())
C.add("AG_11_pivot", lambda s, d: B(s, d).withColumn("q", F.quarter("date")).groupBy(F.year("date").alias("year")).pivot("q", [1, 2, 3, 4]).agg(F.count("code")).select("year", *[F.col(str(q)).alias(f"q{q}") for q in (1, 2, 3, 4)]), "SELECT CAST(year(date) AS INTEGER) AS year, " + ", ".join(f"nullif(count(*) FILTER (WHERE quarter(date) = {q}), 0) AS q{q}" for q in (1, 2, 3, 4)) + " FROM bars GROUP BY 1", dates=(), values=())


def _cells(s, d):
    """Mean, deviation and share of gains, merged from cells by (month, bucket) that hold sums alone."""
    r = panel.returns(B(s, d)).where("ret is not null").withColumn("bucket", F.ntile(5).over(Window.partitionBy("date").orderBy("vol", "code")))
    cells = r.groupBy(F.trunc("date", "month").alias("month"), "bucket").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"), F.sum((F.col("ret") > 0).cast("long")).alias("wins"))
    m = cells.rollup("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("wins").alias("wins"))
    mean = F.col("s") / F.col("n")
    return m.select("bucket", "n", mean.alias("mean"), F.sqrt((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("sd"), (F.col("wins") / F.col("n")).alias("win"))


C.add("AG_12_cells", _cells, """r AS (SELECT * FROM (SELECT code, date, vol, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
b AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY vol, code) AS bucket FROM r)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win FROM b GROUP BY ROLLUP (bucket)""", dates=(), values=("mean", "sd", "win"))
C.add("AG_13_rollup", lambda s, d: B(s, d).rollup(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("close").alias("value"), F.count("*").alias("n")), "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, avg(close) AS value, count(*) AS n FROM bars GROUP BY ROLLUP (year(date), month(date))", dates=())
C.add("AG_14_tokens", lambda s, d: X.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")), "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' GROUP BY token", dates=(), values=())

# Windows
W = "WINDOW w AS (PARTITION BY code ORDER BY date)"
C.add("WN_01_lag_lead", lambda s, d: B(s, d).select("code", "date", (ts.lead("close", 2) - ts.delay("close", 2)).alias("value")), f"SELECT code, date, lead(close, 2) OVER w - lag(close, 2) OVER w AS value FROM bars {W}")
C.add("WN_02_dedupe", lambda s, d: panel.latest(X.reports(s, d), ["code"], [F.desc("notice"), F.desc("period")]).select("code", "period", "notice", "revenue"), "SELECT code, period, notice, revenue FROM reports QUALIFY row_number() OVER (PARTITION BY code ORDER BY notice DESC, period DESC) = 1", dates=("period", "notice"), values=("revenue",))


def _bydate():
    return Window.partitionBy("date").orderBy("vol")


C.add("WN_03_ranks", lambda s, d: B(s, d).select("code", "date", F.rank().over(_bydate()).alias("r"), F.dense_rank().over(_bydate()).alias("dr"), F.ntile(10).over(Window.partitionBy("date").orderBy("vol", "code")).alias("nt"), F.percent_rank().over(_bydate()).alias("value")), "SELECT code, date, CAST(rank() OVER v AS INTEGER) AS r, CAST(dense_rank() OVER v AS INTEGER) AS dr, CAST(ntile(10) OVER (PARTITION BY date ORDER BY vol, code) AS INTEGER) AS nt, percent_rank() OVER v AS value FROM bars WINDOW v AS (PARTITION BY date ORDER BY vol)")
C.add("WN_04_rows_frames", lambda s, d: B(s, d).select("code", "date", F.avg("close").over(ts.rows(-8, -3)).alias("a"), F.sum("vol").over(ts.rows(None, -1)).alias("b")), f"SELECT code, date, avg(close) OVER (w ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS a, sum(vol) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM bars {W}", values=("a", "b"))
C.add("WN_05_range_frames", lambda s, d: B(s, d).withColumn("m", (F.year("date") * 12 + F.month("date")).cast("int")).select("code", "date", F.sum("vol").over(Window.partitionBy("code").orderBy("m").rangeBetween(-2, 0)).alias("value")), "SELECT code, date, sum(vol) OVER (PARTITION BY code ORDER BY year(date) * 12 + month(date) RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM bars")


def _suppressed(s, d):
    later = F.min("notice").over(Window.partitionBy("code").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1))
    return X.reports(s, d).withColumn("later", later).select("code", "period", "notice", "later")


C.add("WN_06_suffix_min", _suppressed, "SELECT code, period, notice, min(notice) OVER (PARTITION BY code ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM reports", dates=("period", "notice", "later"), values=())


def _named(s, d):
    B(s, d).createOrReplaceTempView("panelwright_named")
    return s.sql("SELECT code, date, avg(close) OVER w AS a, max(close) OVER w AS b FROM panelwright_named WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")


C.add("WN_07_named", _named, "SELECT code, date, avg(close) OVER v AS a, max(close) OVER v AS b FROM bars WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", values=("a", "b"))


def _nested(s, d):
    r = panel.returns(B(s, d)).withColumn("z", ts.zscore("ret", 20, 10))
    return r.select("code", "date", ts.mean(F.pow("z", F.lit(3)), 20, 10).alias("value"))


C.add("WN_08_nested", _nested, """r AS (SELECT code, date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM bars),
z AS (SELECT code, date, CASE WHEN count(ret) OVER v >= 10 AND min(ret) OVER v < max(ret) OVER v THEN (ret - avg(ret) OVER v) / stddev_samp(ret) OVER v END AS z FROM r WINDOW v AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING))
SELECT code, date, CASE WHEN count(z) OVER v >= 10 THEN avg(z ** 3) OVER v END AS value FROM z WINDOW v AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""")


def _share(s, d):
    w = Window.partitionBy("code", "date").orderBy(F.desc("vol"), "datetime")
    m = X.minutes(s, d)
    m = m.withColumn("cum", F.sum("vol").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("vol").over(Window.partitionBy("code", "date")))
    return m.where("cum <= 0.2").groupBy("code", "date").agg(F.count("*").alias("n"), F.sum("amount").alias("value"))


C.add("WN_09_volume_share", _share, """c AS (SELECT *, sum(vol) OVER (PARTITION BY code, date ORDER BY vol DESC, datetime ROWS UNBOUNDED PRECEDING) / sum(vol) OVER (PARTITION BY code, date) AS cum FROM minutes)
SELECT code, date, count(*) AS n, sum(amount) AS value FROM c WHERE cum <= 0.2 GROUP BY 1, 2""")

# Selections
C.add("TK_01_order", lambda s, d: B(s, d).select("code", "date", "close").orderBy("date", "code"), "SELECT code, date, close FROM bars ORDER BY date, code", values=("close",))
C.add("TK_02_top_per_date", lambda s, d: panel.top_per_date(B(s, d), "amount", 10).select("code", "date", "rank"), "SELECT code, date, CAST(row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS INTEGER) AS rank FROM bars QUALIFY rank <= 10", values=())
C.add("TK_03_top_global", lambda s, d: B(s, d).select("code", "date", "amount").orderBy(F.desc("amount"), "code", "date").limit(25), "SELECT code, date, amount FROM bars ORDER BY amount DESC, code, date LIMIT 25", values=("amount",))
C.add("TK_04_every_kth", lambda s, d: panel.every_kth(B(s, d), 5, 2), "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i >= 2 AND (i - 2) % 5 = 0", values=())


def _spread(s, d, n: int = 60):
    w = Window.orderBy("date")
    x = B(s, d).select("date").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy()) - 1)
    return x.where(F.floor(F.col("i") * (n - 1) / F.col("m")) != F.floor((F.col("i") - 1) * (n - 1) / F.col("m"))).select("date")


C.add("TK_05_evenly_spaced", _spread, "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () - 1 AS m FROM (SELECT DISTINCT date FROM bars)) WHERE floor(i * 59.0 / m) <> floor((i - 1) * 59.0 / m)", values=())
C.add("TK_06_period_end", lambda s, d: B(s, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date")), "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date FROM bars GROUP BY 1", dates=("month", "date"), values=())


def _two_stage(s, d):
    b = panel.top_per_date(B(s, d), "amount", 40).drop("rank")
    return panel.top_per_date(b, "vol", 10).select("code", "date", "rank")


C.add("TK_07_two_stage", _two_stage, """p AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) <= 40)
SELECT code, date, CAST(row_number() OVER (PARTITION BY date ORDER BY vol DESC, code) AS INTEGER) AS rank FROM p QUALIFY rank <= 10""", values=())


def _buffer(s, d, n: int = 20, keep: int = 30):
    """This year's pool: last year's members that still rank within `keep`, filled to n by rank."""
    y = B(s, d).groupBy(F.year("date").alias("year"), "code").agg(F.sum("amount").alias("a"))
    y = y.withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("a"), "code")))
    old = y.where(F.col("r") <= n).select((F.col("year") + 1).alias("year"), "code", F.lit(True).alias("was"))
    j = y.join(old, ["year", "code"], "left").where((F.col("r") <= n) | (F.col("was") & (F.col("r") <= keep)))
    order = Window.partitionBy("year").orderBy(F.when(F.col("was"), 0).otherwise(1), "r")
    return j.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("year", "code", F.coalesce("was", F.lit(False)).alias("kept"))


C.add("TK_08_buffer", _buffer, """y AS (SELECT CAST(year(date) AS INTEGER) AS year, code, sum(amount) AS a FROM bars GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY a DESC, code) AS r FROM y),
j AS (SELECT r.year, r.code, r.r, o.code IS NOT NULL AS was FROM r LEFT JOIN r o ON o.year + 1 = r.year AND o.code = r.code AND o.r <= 20 WHERE r.r <= 20 OR (o.code IS NOT NULL AND r.r <= 30))
SELECT year, code, was AS kept FROM j QUALIFY row_number() OVER (PARTITION BY year ORDER BY CASE WHEN was THEN 0 ELSE 1 END, r) <= 20""", dates=(), values=())

# Sets
_two = lambda s, d: (B(s, d).where("vol > 60").select("code", "date"), B(s, d).where("high > 2 * low").select("code", "date"))
_A, _Z = "SELECT code, date FROM bars WHERE vol > 60", "SELECT code, date FROM bars WHERE high > 2 * low"
C.add("ST_01_union_all", lambda s, d: B(s, d).select("code", "date", F.lit("close").alias("factor"), F.col("close").alias("value")).unionByName(B(s, d).select("code", "date", F.lit("vol").alias("factor"), F.col("vol").alias("value"))), "SELECT code, date, 'close' AS factor, close AS value FROM bars UNION ALL SELECT code, date, 'vol', vol FROM bars")
C.add("ST_02_unpivot", lambda s, d: panel.forward_returns(B(s, d), (1, 4)).select("code", "date", "fwd_1", "fwd_4").unpivot(["code", "date"], ["fwd_1", "fwd_4"], "h", "value"), "SELECT code, date, 'fwd_1' AS h, lead(close, 1) OVER v / close - 1 AS value FROM bars WINDOW v AS (PARTITION BY code ORDER BY date) UNION ALL SELECT code, date, 'fwd_4', lead(close, 4) OVER v / close - 1 FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)")
C.add("ST_03_intersect", lambda s, d: _two(s, d)[0].intersect(_two(s, d)[1]), f"{_A} INTERSECT {_Z}", values=())
C.add("ST_04_except", lambda s, d: _two(s, d)[0].exceptAll(_two(s, d)[1]), f"{_A} EXCEPT ALL {_Z}", values=())
C.add("ST_05_keep_last", lambda s, d: src.keep_last([B(s, d).select("code", "date", "close"), B(s, d).where("vol > 50").select("code", "date", (-F.col("close")).alias("close"))], ["code", "date"]), "SELECT code, date, CASE WHEN vol > 50 THEN -close ELSE close END AS close FROM bars", values=("close",))
C.add("ST_06_merge_streams", lambda s, d: X.reports(s, d).select("code", F.col("notice").alias("date"), F.col("revenue").alias("v")).unionByName(X.actions(s, d).select("code", "date", F.col("cash").alias("v"))).groupBy("code", "date").agg(F.avg("v").alias("value")), "SELECT code, date, avg(v) AS value FROM (SELECT code, notice AS date, revenue AS v FROM reports UNION ALL SELECT code, date, cash FROM actions) GROUP BY 1, 2", digits=3)

# Scalars
C.add("SC_01_math", lambda s, d: B(s, d).select("code", "date", (F.ln("close") + F.sqrt("vol") + F.pow(F.col("vol"), F.lit(0.25)) + F.pi() + F.exp(-F.col("vol") / 100) + F.greatest("open", "close") - F.least("open", "close")).alias("value")), "SELECT code, date, ln(close) + sqrt(vol) + pow(vol, 0.25) + pi() + exp(-vol / 100) + greatest(open, close) - least(open, close) AS value FROM bars")
C.add("SC_02_null", lambda s, d: B(s, d).select("code", "date", F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(-1.0)).alias("value")), "SELECT code, date, coalesce(nullif(high - low, 0), -1) AS value FROM bars")
C.add("SC_03_date", lambda s, d: B(s, d).select("date").distinct().select("date", F.year("date").alias("y"), F.quarter("date").alias("q"), F.month("date").alias("m"), F.trunc("date", "month").alias("first"), F.weekofyear("date").alias("w"), F.date_add("date", 45).alias("later"), F.date_format("date", "HH:mm").alias("clock")), "SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS y, CAST(quarter(date) AS INTEGER) AS q, CAST(month(date) AS INTEGER) AS m, CAST(date_trunc('month', date) AS DATE) AS first, CAST(weekofyear(date) AS INTEGER) AS w, date + 45 AS later, strftime(date, '%H:%M') AS clock FROM bars", dates=("date", "first", "later"), values=())
C.add("SC_04_string", lambda s, d: X.table(s, d, "supplier").select("s_suppkey", F.substring("s_name", 1, 4).alias("a"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("b"), F.col("s_name").startswith("Supp").alias("c"), F.col("s_name").rlike("[0-9]+1$").alias("e"), F.col("s_name").like("%9%").alias("f")), "SELECT s_suppkey, substr(s_name, 1, 4) AS a, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS b, starts_with(s_name, 'Supp') AS c, regexp_matches(s_name, '[0-9]+1$') AS e, s_name LIKE '%9%' AS f FROM supplier", dates=(), values=())
C.add("SC_05_array", lambda s, d: X.groups(s, d).groupBy("coarse").agg(F.array_sort(F.collect_list("code")).alias("codes")).select("coarse", F.explode("codes").alias("code")), "SELECT coarse, code FROM groups", dates=(), values=())

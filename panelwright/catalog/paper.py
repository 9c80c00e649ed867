"""Paper tracking of snapshots: several models at once, no account."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.operators import asof, panel

C = X.Catalog()
B = X.bars

SNAP = """g AS (SELECT date, lead(date) OVER (ORDER BY date) AS until FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 8 = 0),
snap AS (SELECT 'amount' AS model, date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM bars SEMI JOIN g USING (date)) WHERE r <= 10
  UNION ALL SELECT 'vol', date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY vol DESC, code) AS r FROM bars SEMI JOIN g USING (date)) WHERE r <= 10),
held AS (SELECT model, snap.date AS d0, until, snap.code, close AS c0 FROM snap JOIN g ON g.date = snap.date JOIN bars ON bars.code = snap.code AND bars.date = snap.date),
curve AS (SELECT model, b.date, d0, avg(b.close / c0 - 1) AS ret, count(*) AS n FROM held JOIN bars b ON b.code = held.code AND b.date > d0 AND (until IS NULL OR b.date <= until) GROUP BY 1, 2, 3)
"""


def snapshots(s, d, every: int = 8, n: int = 10):
    """(model, d0, until, code, c0): the top n by amount and by volume on every `every`-th date."""
    b = B(s, d)
    g = panel.every_kth(b, every).withColumn("until", F.lead("date").over(Window.orderBy("date")))
    x = b.join(F.broadcast(g), "date")
    out = None
    for model in ("amount", "vol"):
        t = panel.top_per_date(x, model, n).select(F.lit(model).alias("model"), F.col("date").alias("d0"), "until", "code", F.col("close").alias("c0"))
        out = t if out is None else out.unionByName(t)
    return out


def curve(s, d):
    """Mean return since its snapshot of each model's holdings, on every date until the next snapshot."""
    b = B(s, d).select("code", "date", "close")
    h = snapshots(s, d)
    # a date belongs to the last snapshot before it: one row a date, so holdings meet their bars by equal keys
    dates = asof.asof(b.select("date", F.lit(1).alias("k")).distinct(), h.select(F.col("d0").alias("date"), F.lit(1).alias("k"), "d0").distinct(), ["d0"], by="k", strict=True).where("d0 is not null")
    j = h.join(b.join(F.broadcast(dates.select("date", "d0")), "date"), ["code", "d0"])
    return j.groupBy("model", "date", "d0").agg(F.avg(F.col("close") / F.col("c0") - 1).alias("ret"), F.count("*").alias("n"))


C.add("PF_18_paper_curve", curve, SNAP + "SELECT model, date, d0, ret, n FROM curve", dates=("date", "d0"), values=("ret",))


def _gate(s, d, h: int = 4):
    """Per model: matured and pending snapshot rows, mean and win rate of the forward return, and whether there are 60."""
    f = panel.forward_returns(B(s, d), (h,)).select("code", F.col("date").alias("d0"), f"fwd_{h}")
    j = snapshots(s, d).join(f, ["code", "d0"])
    x = F.col(f"fwd_{h}")
    return j.groupBy("model").agg(F.count(x).alias("matured"), F.count(F.when(x.isNull(), 1)).alias("pending"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("win"), (F.count(x) >= 60).alias("enough"))


C.add("PF_29_gate", _gate, SNAP + """, f AS (SELECT code, date AS d0, lead(close, 4) OVER (PARTITION BY code ORDER BY date) / close - 1 AS f FROM bars)
SELECT model, count(f) AS matured, count(*) - count(f) AS pending, avg(f) AS mean, avg(CAST(f > 0 AS INTEGER)) AS win, count(f) >= 60 AS enough FROM held JOIN f USING (code, d0) GROUP BY 1""", dates=(), values=("mean", "win"))


def _summary(s, d):
    """Per model: snapshots, days, first and last date, compounded return of the finished periods."""
    last = curve(s, d).groupBy("model", "d0").agg(F.max_by("ret", "date").alias("ret"), F.count("*").alias("days"), F.max("date").alias("last"))
    return last.groupBy("model").agg(F.count("*").alias("snapshots"), F.sum("days").alias("days"), F.min("d0").alias("first"), F.max("last").alias("last"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("value"))


C.add("PF_30_paper_summary", _summary, SNAP + """, l AS (SELECT model, d0, arg_max(ret, date) AS ret, count(*) AS days, max(date) AS last FROM curve GROUP BY 1, 2)
SELECT model, count(*) AS snapshots, CAST(sum(days) AS BIGINT) AS days, min(d0) AS first, max(last) AS last, exp(sum(ln(1 + ret))) - 1 AS value FROM l GROUP BY 1""", dates=("first", "last"), digits=2)


def _replay(s, d):
    """One snapshot's holdings marked with fixed weights through a later window."""
    b = B(s, d).where("date between '2000-01-01' and '2000-12-31'").select("code", "date", "close")
    h = snapshots(s, d).where("d0 = (date '1995-01-02')").select("model", "code", F.lit(0.1).alias("w"))
    first = b.groupBy("code").agg(F.min_by("close", "date").alias("c0"))
    return h.join(first, "code").join(b, "code").groupBy("model", "date").agg((F.sum(F.col("w") * (F.col("close") / F.col("c0") - 1)) / F.sum("w")).alias("value"))


C.add("PF_26_replay", _replay, SNAP + """, y AS (SELECT code, date, close FROM bars WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'), c AS (SELECT code, arg_min(close, date) AS c0 FROM y GROUP BY 1)
SELECT model, y.date, avg(y.close / c.c0 - 1) AS value FROM (SELECT model, code FROM held WHERE d0 = DATE '1995-01-02') h JOIN c ON c.code = h.code JOIN y ON y.code = h.code GROUP BY 1, 2""")

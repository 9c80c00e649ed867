"""Verdicts on factors by rules, and which composites they let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule trips where its metric is above (or below) a bound; the worst level that trips is the verdict.
LEVELS = ("PASS", "WARN", "FAIL")
RULES = [
    ("knows_the_future", "FAIL", "different", "above", 0.0),
    ("history_moves", "FAIL", "moved", "above", 0.0),
    ("mostly_null", "FAIL", "nulls", "above", 0.5),
    ("many_nulls", "WARN", "nulls", "above", 0.1),
    ("stands_still", "FAIL", "constant", "above", 0.5),
    ("dates_without_values", "WARN", "covered", "below", 0.8),
]


def audit(factors: DataFrame) -> DataFrame:
    """factor, nulls (share of rows without a value), covered (share of dates with some value), constant (share of codes whose values never change)."""
    dates = factors.groupBy("factor", "date").agg(F.count("*").alias("rows"), F.count("value").alias("n"))
    share = dates.groupBy("factor").agg((1 - F.sum("n") / F.sum("rows")).alias("nulls"), F.avg((F.col("n") > 0).cast("double")).alias("covered"))
    codes = factors.groupBy("factor", "code").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    still = codes.groupBy("factor").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("constant"))
    return share.join(still, "factor")


def verdicts(metrics: DataFrame, rules: list[tuple[str, str, str, str, float]] = RULES) -> DataFrame:
    """factor, verdict, tripped (the rules, in order) for a row of metrics each; a metric that is null trips nothing."""
    table = metrics.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "i int, rule string, level string, metric string, side string, bound double")
    used = sorted({r[2] for r in rules})
    long = metrics.select("factor", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in used])).alias("m")).select("factor", "m.metric", "m.x")
    trips = F.coalesce(F.when(F.col("side") == "above", F.col("x") > F.col("bound")).otherwise(F.col("x") < F.col("bound")), F.lit(False))
    rank = F.when(trips, F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))).otherwise(1)
    d = long.join(F.broadcast(table), "metric").withColumns({"t": trips, "rank": rank})  # the rules are a list of a few rows
    d = d.groupBy("factor").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_list(F.when(F.col("t"), F.struct("i", "rule")))).alias("tripped"))
    return d.select("factor", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("rank").cast("int")).alias("verdict"), F.concat_ws(",", F.transform("tripped", lambda r: r["rule"])).alias("tripped"))


def gate(composites: DataFrame, verdict: DataFrame) -> DataFrame:
    """composite, members, failed, open: composites (composite, factor) stay closed while a member fails or was never judged."""
    d = composites.join(verdict, "factor", "left").withColumn("bad", F.coalesce(F.col("verdict") == "FAIL", F.lit(True)).cast("int"))
    d = d.groupBy("composite").agg(F.count("*").alias("members"), F.sum("bad").alias("failed"))
    return d.withColumn("open", F.col("failed") == 0)

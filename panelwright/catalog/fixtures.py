"""Panel views over the driver's tables, as DataFrames and as SQL.

Money is summed in whole cents and divided once, so that values are equal to the last bit in every engine.
"""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.shipping import ship

#: Which orders make up the items of a quarter's statements.
ITEMS = {"revenue": "true", "net_profit": "o_orderstatus = 'F'", "operate_cf": "o_orderpriority = '1-URGENT'", "debt": "o_orderpriority = '2-HIGH'", "fees": "o_orderpriority = '4-NOT SPECIFIED'", "cost": "o_orderpriority = '5-LOW'"}

VIEWS = {
    "bars": """SELECT code, date, (high + low) / 2 AS open, high, low, cents / vol / 100 AS close, vol, amount FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) AS cents, sum(l_quantity) AS vol,
  CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS DOUBLE) / 10000 AS amount
  FROM lineitem GROUP BY 1, 2)""",
    "actions": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 0.01::DOUBLE * max(l_extendedprice / l_quantity) AS cash
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1 GROUP BY 1, 2""",
    "reports": """SELECT code, period, CAST(period + CAST(15 + (CAST(code AS BIGINT) * 7 + quarter(period) * 13) % 90 AS INTEGER) AS DATE) AS notice, revenue, net_profit FROM (
  SELECT CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS code, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period,
    CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 AS revenue,
    CAST(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS DOUBLE) / 100 AS net_profit FROM orders GROUP BY 1, 2)""",
    "groups": """SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(s_nationkey AS VARCHAR) AS fine, CAST(n_regionkey AS VARCHAR) AS coarse, s_acctbal AS balance,
  10000.0 + 100.0 * s_suppkey AS shares FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "flow": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  CAST(CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) WHEN l_returnflag = 'R' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS DOUBLE) / 100 AS main_net FROM lineitem GROUP BY 1, 2""",
    "flows": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  CAST(CAST(sum(CASE WHEN l_quantity <= 10 AND l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) WHEN l_quantity <= 10 AND l_returnflag = 'R' THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS DOUBLE) / 100 AS small_net,
  CAST(CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE -CAST(round(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS DOUBLE) / 100 AS net_amount FROM lineitem GROUP BY 1, 2""",
    "seats": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, l_linestatus AS seat,
  CAST(CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE -CAST(round(l_extendedprice * 100) AS BIGINT) END) AS BIGINT) AS DOUBLE) / 100 AS net FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3""",
    "blocks": """SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 AS amount,
  CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 100 / sum(l_quantity) AS price FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2""",
    "capital": """SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('year', l_shipdate) AS DATE) AS date, (10000.0 + 100.0 * l_suppkey) * (year(l_shipdate) - 1972) / 20 AS float_shares,
  (10000.0 + 100.0 * l_suppkey) * (year(l_shipdate) - 1972) / 20 * 1.2 AS total_shares FROM lineitem""",
    "items": """SELECT code, period, CAST(period + CAST(15 + (CAST(code AS BIGINT) * 7 + quarter(period) * 13) % 90 AS INTEGER) AS DATE) AS notice, year(period) * 4 + quarter(period) AS q, revenue, net_profit, operate_cf, revenue - cost AS gross_profit,
  revenue - cost - fees AS op_profit, 4 * revenue AS total_assets, 2 * debt AS total_liab, 4 * revenue - 2 * debt AS total_equity, fees AS inventory, fees / 4 AS goodwill, cost / 8 AS one_off, CASE WHEN debt > 0 THEN revenue / debt END AS current_ratio
  FROM (SELECT CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS code, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period, """
    + ", ".join(f"CAST(CAST(sum(CASE WHEN {c} THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS DOUBLE) / 100 AS {n}" for n, c in ITEMS.items())
    + """ FROM orders GROUP BY 1, 2)""",
    "minutes": """SELECT event_type AS code, date_trunc('minute', ts) AS datetime, CAST(ts AS DATE) AS date, (max(value) + min(value)) / 2 AS open, max(value) AS high,
  min(value) AS low, CAST(CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS DOUBLE) / 1000 / count(*) AS close, CAST(count(*) + sum(user_id % 7) AS DOUBLE) AS vol,
  CAST(CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS DOUBLE) / 1000 AS amount FROM events GROUP BY 1, 2, 3""",
}


def sql(body: str) -> str:
    """body after WITH clauses for the views that it names."""
    use = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    if not use:
        return body
    more = not body.lstrip().upper().startswith("SELECT")
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in use) + (",\n" if more else "\n") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _week(c: str):
    return F.date_trunc("week", c).cast("date")


def _cents(c: str, unit: int = 100):
    return F.round(F.col(c) * unit).cast("long")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by supplier."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), _week("l_shipdate").alias("date")).agg(
        F.max(p).alias("high"), F.min(p).alias("low"), F.sum(_cents("l_extendedprice")).cast("double").alias("cents"), F.sum("l_quantity").alias("vol"),
        (F.sum(_cents("l_extendedprice") * (100 - _cents("l_discount"))).cast("double") / 10000).alias("amount"),
    )
    return d.select("code", "date", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", (F.col("cents") / F.col("vol") / 100).alias("close"), "vol", "amount")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1))
    return d.groupBy(F.col("l_suppkey").cast("string").alias("code"), _week("l_shipdate").alias("date")).agg((F.lit(0.01) * F.max(F.col("l_extendedprice") / F.col("l_quantity"))).alias("cash"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports with a publication date that can overtake the next one's."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    period = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    d = table(spark, sf_dir, "orders").join(F.broadcast(n)).groupBy((F.col("o_custkey") % F.col("n")).cast("string").alias("code"), period.alias("period")).agg(
        (F.sum(_cents("o_totalprice")).cast("double") / 100).alias("revenue"), (F.sum(F.when(F.col("o_orderstatus") == "F", _cents("o_totalprice")).otherwise(0)).cast("double") / 100).alias("net_profit"))
    notice = F.date_add("period", (15 + (F.col("code").cast("long") * 7 + F.quarter("period") * 13) % 90).cast("int"))
    return d.select("code", "period", notice.alias("notice"), "revenue", "net_profit")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    d = s.join(n, s.s_nationkey == n.n_nationkey)
    return d.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").cast("string").alias("fine"), F.col("n_regionkey").cast("string").alias("coarse"), F.col("s_acctbal").alias("balance"), (F.lit(10000.0) + 100.0 * F.col("s_suppkey")).alias("shares"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "A", _cents("l_extendedprice")).when(F.col("l_returnflag") == "R", -_cents("l_extendedprice")).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), _week("l_shipdate").alias("date")).agg((F.sum(signed).cast("double") / 100).alias("main_net"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flow of small trades, and of all trades by the side that began them."""
    price = _cents("l_extendedprice")
    small = F.when((F.col("l_quantity") <= 10) & (F.col("l_returnflag") == "A"), price).when((F.col("l_quantity") <= 10) & (F.col("l_returnflag") == "R"), -price).otherwise(0)
    whole = F.when(F.col("l_linestatus") == "F", price).otherwise(-price)
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("code"), _week("l_shipdate").alias("date"))
    return d.agg((F.sum(small).cast("double") / 100).alias("small_net"), (F.sum(whole).cast("double") / 100).alias("net_amount"))


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two kinds of seats bought net, by day."""
    d = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    net = F.when(F.col("l_returnflag") == "A", _cents("l_extendedprice")).otherwise(-_cents("l_extendedprice"))
    return d.groupBy(F.col("l_suppkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("seat")).agg((F.sum(net).cast("double") / 100).alias("net"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of much volume, by day."""
    d = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    amount = F.sum(_cents("l_extendedprice")).cast("double") / 100
    return d.groupBy(F.col("l_suppkey").cast("string").alias("code"), F.to_date("l_shipdate").alias("date")).agg(amount.alias("amount"), (amount / F.sum("l_quantity")).alias("price"))


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares from the start of each year."""
    shares = (F.lit(10000.0) + 100.0 * F.col("l_suppkey")) * (F.year("l_shipdate") - 1972) / 20
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("code"), F.trunc("l_shipdate", "year").alias("date"), shares.alias("float_shares"), (shares * 1.2).alias("total_shares")).distinct()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement items of single quarters with their publication date, and the quarter's number q."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    period = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    sums = [(F.sum(F.when(F.expr(c), _cents("o_totalprice")).otherwise(0)).cast("double") / 100).alias(i) for i, c in ITEMS.items()]
    d = table(spark, sf_dir, "orders").join(F.broadcast(n)).groupBy((F.col("o_custkey") % F.col("n")).cast("string").alias("code"), period.alias("period")).agg(*sums)
    notice = F.date_add("period", (15 + (F.col("code").cast("long") * 7 + F.quarter("period") * 13) % 90).cast("int"))
    c = F.col
    return d.select(
        "code", "period", notice.alias("notice"), (F.year("period") * 4 + F.quarter("period")).alias("q"), "revenue", "net_profit", "operate_cf", (c("revenue") - c("cost")).alias("gross_profit"), (c("revenue") - c("cost") - c("fees")).alias("op_profit"), (4 * c("revenue")).alias("total_assets"),
        (2 * c("debt")).alias("total_liab"), (4 * c("revenue") - 2 * c("debt")).alias("total_equity"), c("fees").alias("inventory"), (c("fees") / 4).alias("goodwill"), (c("cost") / 8).alias("one_off"), F.when(c("debt") > 0, c("revenue") / c("debt")).alias("current_ratio"),
    )


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars by event type."""
    total = F.sum(_cents("value", 1000)).cast("double") / 1000
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), F.date_trunc("minute", "ts").alias("datetime"), F.to_date("ts").alias("date")).agg(
        ((F.max("value") + F.min("value")) / 2).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), (total / F.count("*")).alias("close"),
        (F.count("*") + F.sum(F.col("user_id") % 7)).cast("double").alias("vol"), total.alias("amount"),
    )


SHIFT = 1.7e-6


@contextlib.contextmanager
def nulls_for_errors(spark: SparkSession):
    """Plans made inside give null where a division or cast fails, as SQL engines without ANSI rules do; the session's own setting comes back afterwards."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


class Catalog:
    """Queries and SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, run, body: str | None = None, dates: tuple[str, ...] = ("date",), values: tuple[str, ...] = ("value",), digits: int = 4) -> None:
        """Register a query and its SQL over the views.

        Results show dates as text and values rounded. A small fixed amount is added before rounding, as
        engines differ on values that lie just between two roundings.
        """
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")

        def query(spark, sf_dir):
            ship(spark)
            with nulls_for_errors(spark):
                return shown_as(run(spark, sf_dir))

        def shown_as(df):
            shown = {f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.typeName() == "date"}
            return df.withColumns(shown | {v: F.round(F.col(v).cast("double") + SHIFT, digits) for v in values if v in df.columns})

        self.queries[name] = query
        if body is not None:
            self.oracle[name] = self.text(body, dates, values, digits)

    @staticmethod
    def text(body: str, dates: tuple[str, ...], values: tuple[str, ...], digits: int) -> str:
        parts = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"round(CAST({v} AS DOUBLE) + {SHIFT!r}, {digits}) AS {v}" for v in values]
        return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql(body)}\n)" if parts else sql(body)

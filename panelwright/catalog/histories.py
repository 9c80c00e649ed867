"""Event books with stops and costs, and states from a log of changes, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog import fixtures as X
from panelwright.operators import panel
from panelwright.plans import events as ev
from panelwright.plans import states as st

C = X.Catalog()

# Events: rows of much volume, held eight rows, closed once they have lost a tenth
HOLD, STOP, COST_IN, COST_OUT = 8, 0.1, 0.001, 0.002


def _held(s, d):
    return ev.paths(panel.returns(X.bars(s, d)), F.col("vol") > 80, HOLD, STOP)


HELD = f"""
b AS (SELECT code, date, vol, close / lag(close) OVER v - 1 AS ret, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY code ORDER BY date)),
e AS (SELECT a.code, a.date AS opened, CAST(b.i - a.i AS INTEGER) AS k, b.date, coalesce(b.ret, 0) AS ret FROM b a JOIN b ON b.code = a.code AND b.i BETWEEN a.i + 1 AND a.i + {HOLD} WHERE a.vol > 80),
w AS (SELECT *, product(1 + ret) OVER (PARTITION BY code, opened ORDER BY k ROWS UNBOUNDED PRECEDING) AS worth FROM e),
x AS (SELECT *, min(CASE WHEN worth <= 1 - {STOP} THEN k END) OVER (PARTITION BY code, opened) AS breach FROM w),
held AS (SELECT code, opened, k, date, ret, k = coalesce(breach, {HOLD}) AS last, coalesce(k = breach, false) AS stopped FROM x WHERE k <= coalesce(breach, {HOLD}))
"""
C.add("PF_23_event_paths", _held, HELD + "SELECT * FROM held", dates=("opened", "date"), values=("ret",))
C.add("PF_23_event_costs", lambda s, d: ev.book(_held(s, d), COST_IN, COST_OUT), HELD + f", k AS (SELECT date, count(*) AS n, avg(ret) AS ret, avg(CAST(k = 1 AS INTEGER)) AS entries, avg(CAST(last AS INTEGER)) AS exits, count(*) FILTER (WHERE stopped) AS stops FROM held GROUP BY 1) SELECT *, ret - entries * {COST_IN} - exits * {COST_OUT} AS net FROM k", values=("ret", "entries", "exits", "net"))

# States: an order's priority and status are the name that its customer's code goes by from its date on
RULES = [("^1-URGENT F", 2), ("^(1-URGENT|2-HIGH)", 1), ("NOT SPECIFIED", 9)]


def _log(s, d):
    n = X.table(s, d, "supplier").agg(F.count("*").alias("n"))
    o = X.table(s, d, "orders").join(F.broadcast(n))
    return o.select((F.col("o_custkey") % F.col("n")).cast("string").alias("code"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"), F.to_date("o_orderdate").alias("start"), F.col("o_orderkey").alias("announced"))


LOG = """
log AS (SELECT CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS code, o_orderpriority || ' ' || o_orderstatus AS name, CAST(o_orderdate AS DATE) AS start, o_orderkey AS announced FROM orders),
named AS (SELECT code, start, CASE WHEN regexp_matches(name, '^1-URGENT F') THEN 2 WHEN regexp_matches(name, '^(1-URGENT|2-HIGH)') THEN 1 WHEN regexp_matches(name, 'NOT SPECIFIED') THEN 9 ELSE 0 END AS state
  FROM log QUALIFY row_number() OVER (PARTITION BY code, start ORDER BY announced DESC, name DESC) = 1),
turned AS (SELECT * FROM named QUALIFY coalesce(lag(state) OVER (PARTITION BY code ORDER BY start) <> state, true)),
spans AS (SELECT code, start, lead(start) OVER (PARTITION BY code ORDER BY start) AS until, CAST(state AS INTEGER) AS state FROM turned)
"""
C.add("PIT_12_intervals", lambda s, d: st.intervals(_log(s, d), RULES), "WITH" + LOG + "SELECT * FROM spans", dates=("start", "until"), values=())
C.add("PIT_12_daily", lambda s, d: st.on_dates(X.bars(s, d).select("code", "date"), _log(s, d), RULES).where("state > 0"), LOG + "SELECT b.code, b.date, s.state FROM bars b JOIN spans s ON s.code = b.code AND b.date >= s.start AND (s.until IS NULL OR b.date < s.until) WHERE s.state > 0", values=())

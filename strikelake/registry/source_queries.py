"""Registered queries: scans, sinks, calendars, configuration checks and data checks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .. import calendars
from .. import schemas as S
from ..config import literals, strategy_rows
from ..functions import clock, values
from ..operators import asof
from ..plans import metrics as M
from ..plans import validate as V
from ..session import cut_lineage, shared_folder
from ..sources import bars as B
from ..sources import results as RS
from .inputs import BARS_SQL, CAPITAL, SERIES_SQL, TRADE_ORDER, TRADES_SQL, bars, table, text_dates, trades
from .metric_queries import RUN_METRICS_SQL
from .replay_queries import leg, sl, strategy

START, END = dt.date(2024, 1, 6), dt.date(2024, 1, 24)


def _full_bars(spark, sf):
    """Derived bars with all stored columns."""
    c = F.col
    return bars(spark, sf).select(
        "symbol", F.lit("weekly").alias("expiry_type"), F.year("date").alias("year"), F.month("date").alias("month"),
        F.concat_ws(" ", c("date").cast("string"), "time").alias("timestamp"), "date", "time",
        F.date_format("date", "EEEE").alias("weekday"), "option_type",
        F.concat(F.lit("ATM"), F.when(c("strike_offset") > 0, "+").otherwise(""), F.when(c("strike_offset") != 0, c("strike_offset").cast("string")).otherwise("")).alias("strike_label"),
        "strike_offset", F.when(c("strike_offset") == 0, "ATM").otherwise("OTM").alias("moneyness"),
        "open", "high", "low", "close", "volume", "strike", "oi", "spot", "iv",
    )


def _stored(spark, sf):
    base = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    B.write_bars(_full_bars(spark, sf), base)
    return base


BAR_OUT = ["symbol", "date", "time", "option_type", "strike_offset", "open", "high", "low", "close", "volume", "oi", "spot", "iv"]


def scan_bars(spark, sf):
    got = B.scan_bars(spark, _stored(spark, sf), None, ["weekly"], START, END)
    return text_dates(got.select(*BAR_OUT, "timestamp", "strike_label"))


SCAN_SQL = f"""WITH {BARS_SQL} SELECT symbol, CAST(date AS VARCHAR) AS date, time, option_type, CAST(strike_offset AS BIGINT) AS strike_offset, open, high, low, close, volume, oi,
  round(spot,6) AS spot, iv, CAST(date AS VARCHAR) || ' ' || time AS timestamp,
  'ATM' || CASE WHEN strike_offset>0 THEN '+' ELSE '' END || CASE WHEN strike_offset<>0 THEN CAST(strike_offset AS VARCHAR) ELSE '' END AS strike_label
FROM bars WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-24'"""


def list_available(spark, sf):
    return text_dates(B.list_available(spark, _stored(spark, sf)))


AVAILABLE_SQL = f"""WITH {BARS_SQL} SELECT DISTINCT symbol, 'weekly' AS expiry_type, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month FROM bars"""


def file_inventory(spark, sf):
    """Symbols and months by the files' paths, and whether every file has a size, a name and a time."""
    inv = B.file_inventory(spark, _stored(spark, sf))
    part = lambda k: F.regexp_extract("path", r"symbol=([^/]+)/expiry_type=weekly/year=(\d+)/month=(\d+)/[^/]+$", k)
    whole = (F.col("bytes") > 0) & F.endswith("path", F.col("name")) & F.col("modified").isNotNull() & (F.abs(F.col("size_mb") - F.col("bytes") / 1048576) <= 0.005)
    return text_dates(
        inv.groupBy(part(1).alias("symbol"), part(2).cast("int").alias("year"), part(3).cast("int").alias("month")).agg(F.bool_and(whole).alias("whole"))
    )


INVENTORY_SQL = f"""WITH {BARS_SQL} SELECT DISTINCT symbol, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(1 AS BIGINT) AS whole FROM bars"""


def ingest_csv(spark, sf):
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = _full_bars(spark, sf).drop("symbol", "expiry_type", "year", "month")
    # Spoil some fields: a decimal in an integer column, text in a number, no date.
    spoiled = rows.withColumns(
        {
            "volume": F.when(F.col("strike_offset") == 2, F.concat(F.col("volume").cast("string"), F.lit(".0"))).otherwise(F.col("volume").cast("string")),
            "iv": F.when(F.col("strike_offset") == 1, "n/a").otherwise(F.col("iv").cast("string")),
            "date": F.when(F.col("time") == "23:00:00", "unknown").otherwise(F.col("date").cast("string")),
        }
    )
    spoiled.write.option("header", True).csv(base)
    got = B.ingest_csv(spark, base, "ALL")
    return text_dates(
        got.groupBy("symbol", "year", "month", "date", "strike_offset").agg(
            F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum((F.col("iv") * 100).cast("int")).alias("iv100"),
            F.max("close").alias("close"),
        )
    )


INGEST_SQL = f"""WITH {BARS_SQL} SELECT 'ALL' AS symbol, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(date AS VARCHAR) AS date,
  CAST(strike_offset AS BIGINT) AS strike_offset, count(*) AS n, CAST(CASE WHEN strike_offset=2 THEN 0 ELSE sum(volume) END AS BIGINT) AS volume,
  CAST(CASE WHEN strike_offset=1 THEN 0 ELSE sum(trunc(iv*100)) END AS BIGINT) AS iv100, max(close) AS close
FROM bars WHERE time <> '23:00:00' GROUP BY date, strike_offset"""


def normalize(spark, sf):
    old = _full_bars(spark, sf).drop("timestamp").withColumn("volume", F.col("volume").cast("double"))
    old = old.where("strike_offset < 0").withColumn("time", F.substring("time", 1, 5))
    new = _full_bars(spark, sf).where("strike_offset >= 0").withColumn("iv", F.when(F.col("iv") > 0, F.col("iv")))
    got = B.union_vintages(old, new)
    return text_dates(got.select("symbol", "date", "time", "timestamp", "option_type", "strike_offset", "volume", "iv"))


NORMALIZE_SQL = f"""WITH {BARS_SQL} SELECT symbol, CAST(date AS VARCHAR) AS date, time, CAST(date AS VARCHAR) || ' ' || time AS timestamp, option_type,
  CAST(strike_offset AS BIGINT) AS strike_offset, volume, iv FROM bars"""


def stored_trades(spark, sf):
    """Write trades, read one run back, in trade order."""
    base = f"{shared_folder(spark)}/res-{uuid.uuid4().hex}"
    t = trades(spark, sf)
    RS.write_table(RS.trade_rows(t, TRADE_ORDER), base, "trades")
    got = RS.read_results(spark, base, "trades")
    return text_dates(got.select("run_id", "trade_id", "exit_date", "exit_reason", "pnl_gross", "pnl_net", "brokerage", "lots", "bars_held"))


STORED_SQL = f"""WITH {TRADES_SQL} SELECT CAST(run_id AS BIGINT) AS run_id, trade_id-1 AS trade_id, CAST(exit_date AS VARCHAR) AS exit_date, exit_reason, pnl_gross, pnl_net, brokerage,
  CAST(lots AS BIGINT) AS lots, CAST(bars_held AS BIGINT) AS bars_held FROM trades"""


def stored_equity(spark, sf):
    base = f"{shared_folder(spark)}/res-{uuid.uuid4().hex}"
    daily = M.daily_equity_from_trades(trades(spark, sf), F.lit(CAPITAL))
    RS.write_table(RS.equity_rows(daily), base, "equity_curves")
    return text_dates(RS.read_results(spark, base, "equity_curves", 3), {"drawdown_pct": 9})


STORED_EQUITY_SQL = f"""WITH {TRADES_SQL}, {SERIES_SQL} SELECT CAST(run_id AS BIGINT) AS run_id, CAST(date AS VARCHAR) AS date, equity,
  round((pk-equity)/pk*100,9)+0.0 AS drawdown_pct FROM (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY date) AS pk FROM daily) WHERE run_id=3"""


def _wide(spark, sf):
    from .metric_queries import run_metrics

    return run_metrics(spark, sf)


def metrics_long(spark, sf):
    return text_dates(RS.metrics_long(_wide(spark, sf)), {"metric_value": 9})


LONG_SQL = f"""WITH w AS ({RUN_METRICS_SQL}) UNPIVOT (SELECT run_id, CAST(COLUMNS(* EXCLUDE (run_id)) AS DOUBLE) FROM w)
ON COLUMNS(* EXCLUDE (run_id)) INTO NAME metric_name VALUE metric_value"""


def metrics_map(spark, sf):
    base = f"{shared_folder(spark)}/res-{uuid.uuid4().hex}"
    RS.write_table(RS.metrics_long(_wide(spark, sf)), base, "metrics")
    m = RS.metrics_map(RS.read_results(spark, base, "metrics"))
    return text_dates(m.select("run_id", F.col("metrics")["total_pnl_net"].alias("total_pnl_net"), F.col("metrics")["sharpe_ratio"].alias("sharpe_ratio"), F.size("metrics").alias("n")))


MAP_SQL = f"""SELECT run_id, total_pnl_net, sharpe_ratio, CAST(45 AS BIGINT) AS n FROM ({RUN_METRICS_SQL})"""


def _run_listing(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("strategy_id"), F.col("o_orderdate").alias("inserted_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
    )
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("strategy_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("underlying"))
    return runs, s


_RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS strategy_id, o_orderdate AS inserted_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status FROM orders),
strategies AS (SELECT c_custkey AS strategy_id, c_name AS name, c_mktsegment AS underlying FROM customer)"""


def recent_runs(spark, sf):
    runs, s = _run_listing(spark, sf)
    return RS.recent_runs(runs, s, 25, "completed").select("run_id", "strategy_id", "status", "strategy_name", "underlying", F.date_format("inserted_at", "yyyy-MM-dd").alias("inserted"))


RECENT_SQL = f"""WITH {_RUNS_SQL} SELECT run_id, r.strategy_id, status, name AS strategy_name, underlying, strftime(inserted_at, '%Y-%m-%d') AS inserted
FROM runs r LEFT JOIN strategies s ON s.strategy_id=r.strategy_id WHERE status='completed' ORDER BY inserted_at DESC, run_id DESC LIMIT 25"""


def all_runs(spark, sf):
    runs, s = _run_listing(spark, sf)
    return RS.recent_runs(runs, s).select("run_id", "strategy_id", "status", "strategy_name")


ALL_RUNS_SQL = f"WITH {_RUNS_SQL} SELECT run_id, r.strategy_id, status, name AS strategy_name FROM runs r LEFT JOIN strategies s ON s.strategy_id=r.strategy_id"


def strategy_runs(spark, sf):
    runs, s = _run_listing(spark, sf)
    busiest = runs.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("runs"), F.max("inserted_at").alias("last"))
    out = RS.strategies_by_underlying(s, "BUILDING").join(busiest, "strategy_id", "left")
    return out.select("strategy_id", "name", F.coalesce("runs", F.lit(0)).alias("runs"), F.date_format("last", "yyyy-MM-dd").alias("last_run"))


STRATEGY_RUNS_SQL = f"""WITH {_RUNS_SQL} SELECT s.strategy_id, name, count(run_id) AS runs, strftime(max(inserted_at), '%Y-%m-%d') AS last_run
FROM strategies s LEFT JOIN runs r ON r.strategy_id=s.strategy_id WHERE underlying='BUILDING' GROUP BY s.strategy_id, name"""


def safe_numbers(spark, sf):
    c = F.col
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).when(c("event_id") % 5 == 1, F.lit(float("inf"))).when(c("event_id") % 5 == 2, F.lit(1.5e308)).otherwise(c("value")).alias("v"),
        F.when(c("event_id") % 3 == 0, "n/a").otherwise(c("value").cast("string")).alias("t"),
    )
    return text_dates(e.select("event_id", values.safe_num("v").alias("v"), values.safe_num("t").alias("t"), values.safe_int("t").alias("i"), values.cost_total("v", "t").alias("total")))


SAFE_SQL = """SELECT event_id, CASE WHEN event_id%5 > 2 THEN value END AS v, CASE WHEN event_id%3 > 0 THEN value END AS t,
  CASE WHEN event_id%3 > 0 THEN CAST(trunc(value) AS BIGINT) ELSE 0 END AS i,
  round(CASE WHEN event_id%5 > 2 THEN value ELSE 0 END + CASE WHEN event_id%3 > 0 THEN value ELSE 0 END, 6) AS total FROM events"""


# ------------------------------------------------------------------ calendars

_SYMBOLS = "CASE orderkey % 4 WHEN 0 THEN 'NIFTY' WHEN 1 THEN 'banknifty' WHEN 2 THEN 'SENSEX' ELSE 'OTHER' END"


def _dated(spark, sf):
    """Order dates moved to 2023-2025, spread over the calendar symbols."""
    c = F.col
    o = table(spark, sf, "orders").select(
        c("o_orderkey").alias("orderkey"), F.date_add(F.lit(dt.date(2023, 1, 1)), (F.date_diff(c("o_orderdate").cast("date"), F.lit(dt.date(1995, 1, 1))) % 1090)).alias("date")
    )
    k = c("orderkey") % 4
    return o.withColumn("symbol", F.when(k == 0, "NIFTY").when(k == 1, "banknifty").when(k == 2, "SENSEX").otherwise("OTHER"))


_DATED_SQL = f"""o AS (SELECT o_orderkey AS orderkey, DATE '2023-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 1090 AS INT) AS date FROM orders),
d AS (SELECT orderkey, date, {_SYMBOLS} AS symbol FROM o)"""


def _rules_sql(name, rules, cols):
    body = ", ".join("(" + ", ".join(f"DATE '{v}'" if i in (1, 2) else (f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(r)) + ")" for r in rules)
    return f"{name}({cols}) AS (VALUES {body})"


_LOTS = _rules_sql("lots", calendars.LOT_RULES, "symbol, f, t, size")
_EXPIRIES = _rules_sql("rules", calendars.EXPIRY_RULES, "symbol, f, t, type, day")


def lot_size_asof(spark, sf):
    d = asof.lot_size_asof(_dated(spark, sf), calendars.lot_rules(spark), date="date", default=1)
    return text_dates(d)


LOT_SQL = f"""WITH {_DATED_SQL}, {_LOTS} SELECT orderkey, CAST(date AS VARCHAR) AS date, d.symbol, CAST(coalesce(size,1) AS BIGINT) AS lot_size
FROM d LEFT JOIN lots l ON upper(d.symbol)=l.symbol AND date BETWEEN f AND t"""


def expiry_asof(spark, sf):
    return text_dates(asof.expiry_asof(_dated(spark, sf), calendars.expiry_rules(spark)))


_EXPIRY_CTE = f"""{_DATED_SQL}, {_EXPIRIES},
r AS (SELECT d.*, type, CASE lower(replace(day,'last_','')) WHEN 'monday' THEN 1 WHEN 'tuesday' THEN 2 WHEN 'wednesday' THEN 3 WHEN 'thursday' THEN 4 WHEN 'friday' THEN 5 END AS wd
  FROM d JOIN rules l ON upper(d.symbol)=l.symbol AND date BETWEEN f AND t),
m AS (SELECT *, last_day(date) - CAST((isodow(last_day(date)) - wd + 7) % 7 AS INT) AS e0, last_day(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE)) AS l1 FROM r),
x AS (SELECT *, CAST(CASE WHEN type='weekly' THEN date + CAST((wd - isodow(date) + 7) % 7 AS INT) WHEN date <= e0 THEN e0 ELSE l1 - CAST((isodow(l1) - wd + 7) % 7 AS INT) END AS DATE) AS expiry_date FROM m)"""

EXPIRY_SQL = f"""WITH {_EXPIRY_CTE} SELECT d.orderkey, CAST(d.date AS VARCHAR) AS date, d.symbol, type AS expiry_type, CAST(expiry_date AS VARCHAR) AS expiry_date,
  CAST(date_diff('day', d.date, expiry_date) AS BIGINT) AS dte FROM d LEFT JOIN x ON x.orderkey = d.orderkey"""


def expiry_gate(spark, sf):
    d = _dated(spark, sf).select(F.col("orderkey").cast("string").alias("run_id"), "symbol", "date")
    runs = d.select("run_id", (F.col("run_id").cast("bigint") % 3 == 0).alias("trade_on_expiry"))
    return text_dates(asof.expiry_gate(d, runs, calendars.expiry_rules(spark)))


GATE_SQL = f"""WITH {_EXPIRY_CTE}, g AS (SELECT d.*, date_diff('day', d.date, x.expiry_date) AS dte FROM d LEFT JOIN x ON x.orderkey=d.orderkey)
SELECT CAST(orderkey AS VARCHAR) AS run_id, symbol, CAST(date AS VARCHAR) AS date FROM g WHERE orderkey % 3 = 0 OR dte IS NULL OR dte > 0"""


def uncovered(spark, sf):
    rules = calendars.lot_rules(spark, [r for r in calendars.LOT_RULES if r[1] != "2024-04-26"])
    return text_dates(asof.uncovered_dates(_dated(spark, sf), rules))


UNCOVERED_SQL = f"""WITH {_DATED_SQL}, {_LOTS} SELECT DISTINCT d.symbol, CAST(date AS VARCHAR) AS date FROM d
WHERE NOT EXISTS (SELECT 1 FROM lots l WHERE l.symbol=upper(d.symbol) AND d.date BETWEEN f AND t AND f <> DATE '2024-04-26')"""


def month_shift(spark, sf):
    d = _dated(spark, sf)
    return text_dates(d.select("orderkey", clock.shift_months("date", 7).alias("shifted"), clock.month_label(F.year("date"), F.month("date")).alias("label"),
                               clock.weekday_code(F.lit("last_friday")).alias("code")))


SHIFT_SQL = f"""WITH {_DATED_SQL} SELECT orderkey, CAST(make_date(CAST(year(date) + (month(date)+6)//12 AS BIGINT), CAST((month(date)+6)%12+1 AS BIGINT), least(day(date),28)) AS VARCHAR) AS shifted,
  strftime(date, '%Y-%m') AS label, 'FRI' AS code FROM d"""


# ------------------------------------------------------------------ checks


def checks(spark, sf):
    # Both expiry types in every symbol; the monthly rows have a spot of their own, fewer IVs, and some of them twice.
    b = bars(spark, sf)
    hour, at_money = F.substring("time", 1, 2).cast("int"), F.col("strike_offset") == 0
    far = b.where(hour % 3 > 0).withColumn("spot", F.col("spot") * F.when(hour % 6 == 1, 1.2).otherwise(1.0)).withColumn("iv", F.when(~at_money, F.col("iv")))
    far = far.withColumn("expiry_type", F.lit("monthly"))
    b = cut_lineage(b.withColumn("expiry_type", F.lit("weekly")).unionByName(far).unionByName(far.where(at_money & (F.col("symbol") == "S1"))))
    rules = [("S0", "2000-01-01", "2024-01-20", "weekly", "Thursday"), ("S0", "2024-01-21", "2099-12-31", "monthly", "last_thursday"),
             ("S1", "2024-01-11", "2099-12-31", "monthly", "last_thursday")]
    lots = [("S0", "2024-01-01", "2024-01-15", 10), ("S0", "2024-01-20", "2024-12-31", 20), ("S1", "2024-01-01", "2099-12-31", 10)]
    v = V.validate_bars(b, calendars.expiry_rules(spark, rules), calendars.lot_rules(spark, lots))
    return text_dates(v, {"detail": 4})


CHECKS_SQL = f"""WITH {BARS_SQL}, fa AS (SELECT * REPLACE (spot * CASE WHEN CAST(time[1:2] AS INT) % 6 = 1 THEN 1.2::DOUBLE ELSE 1 END AS spot, CASE WHEN strike_offset <> 0 THEN iv END AS iv), 'monthly' AS expiry_type
  FROM bars WHERE CAST(time[1:2] AS INT) % 3 > 0),
bx AS (SELECT *, 'weekly' AS expiry_type FROM bars UNION ALL SELECT * FROM fa UNION ALL SELECT * FROM fa WHERE strike_offset = 0 AND symbol = 'S1'),
sy AS (SELECT DISTINCT symbol FROM bx), cut(symbol, c) AS (VALUES ('S0', DATE '2024-01-21'), ('S1', DATE '2024-01-11')),
fl AS (SELECT b.symbol, expiry_type, year(date) AS y, month(date) AS m, min(date) AS lo, max(date) AS hi FROM bx b GROUP BY ALL),
k1 AS (SELECT f.symbol, 'weekly_cutoff' AS chk, count(*) FILTER ((expiry_type='weekly' AND hi>=c) OR (expiry_type='monthly' AND lo<c)) AS e, max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS w FROM fl f LEFT JOIN cut USING (symbol) GROUP BY f.symbol),
dd AS (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM (SELECT DISTINCT symbol, date FROM bx)),
k2 AS (SELECT symbol, 'date_gaps' AS chk, count(*) FILTER (date_diff('day', p, date) > 5) AS g FROM dd GROUP BY symbol),
k3 AS (SELECT symbol, sum(n) AS n, sum(u) AS u, count(*) FILTER (n > u) AS files FROM (
  SELECT symbol, count(*) AS n, count(DISTINCT (date, time, strike_offset, option_type)) AS u FROM bx GROUP BY symbol, expiry_type, year(date), month(date)) GROUP BY symbol),
iv AS (SELECT symbol, expiry_type, date, time, count(*) AS c FROM bx WHERE iv > 0 GROUP BY ALL),
k4 AS (SELECT symbol, count(*) FILTER (c>=3)/count(*)*100.0 AS pct FROM iv GROUP BY symbol),
sp AS (SELECT symbol, date, time, spot, lag(spot) OVER (PARTITION BY symbol, expiry_type, year(date), month(date) ORDER BY date, time, spot) AS p FROM (SELECT DISTINCT symbol, expiry_type, date, time, spot FROM bx)),
k5 AS (SELECT symbol, count(*) FILTER (p > 0 AND abs(spot-p)/p > 0.10) AS j FROM sp GROUP BY symbol),
lt(symbol, f, t) AS (VALUES ('S0', DATE '2024-01-01', DATE '2024-01-15'), ('S0', DATE '2024-01-20', DATE '2024-12-31'), ('S1', DATE '2024-01-01', DATE '2099-12-31')),
k6 AS (SELECT s.symbol, (SELECT count(DISTINCT date) FROM bx b WHERE b.symbol=s.symbol AND NOT EXISTS (SELECT 1 FROM lt WHERE lt.symbol=b.symbol AND b.date BETWEEN f AND t)) AS u FROM sy s),
al AS (SELECT symbol, chk, e, w, CAST(e AS DOUBLE) AS d FROM k1
 UNION ALL SELECT symbol, chk, CASE WHEN g>20 THEN 1 ELSE 0 END, g, g FROM k2
 UNION ALL SELECT symbol, 'duplicates', CASE WHEN n>u THEN 1 ELSE 0 END, files, n-u FROM k3
 UNION ALL SELECT symbol, 'iv_coverage', CASE WHEN pct<95 THEN 1 ELSE 0 END, CASE WHEN pct>=95 AND pct<99 THEN 1 ELSE 0 END, pct FROM k4
 UNION ALL SELECT symbol, 'spot_continuity', CASE WHEN j>0 THEN 1 ELSE 0 END, 0, j FROM k5
 UNION ALL SELECT symbol, 'lot_coverage', CASE WHEN u>0 THEN 1 ELSE 0 END, 0, u FROM k6)
SELECT symbol, chk AS "check", CAST(CASE WHEN e=0 THEN 1 ELSE 0 END AS BIGINT) AS passed, CAST(e AS BIGINT) AS n_errors, CAST(w AS BIGINT) AS n_warnings, round(d,4)+0.0 AS detail FROM al"""


def spot_jumps(spark, sf):
    return text_dates(V.spot_jumps(bars(spark, sf), 0.10).select("symbol", "date", "time", "spot", "previous", "change"))


JUMPS_SQL = f"""WITH {BARS_SQL}, sp AS (SELECT symbol, date, time, spot, lag(spot) OVER (PARTITION BY symbol, year(date), month(date) ORDER BY date, time, spot) AS previous FROM (SELECT DISTINCT symbol, date, time, spot FROM bars))
SELECT symbol, CAST(date AS VARCHAR) AS date, time, round(spot,6) AS spot, round(previous,6) AS previous, round(abs(spot-previous)/previous,6) AS change FROM sp WHERE previous > 0 AND abs(spot-previous)/previous > 0.10::DOUBLE"""


def date_gaps(spark, sf):
    """Gaps in each customer's order dates, as a longer series than the bars'."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
    return text_dates(V.date_gaps(o, 60))


GAPS_SQL = """WITH d AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders),
g AS (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS previous FROM d)
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(previous AS VARCHAR) AS previous, CAST(date_diff('day', previous, date) AS BIGINT) AS days FROM g WHERE date_diff('day', previous, date) > 60"""


def duplicates(spark, sf):
    """Duplicate keys when a day's events are taken as bars without aggregation."""
    e = table(spark, sf, "events")
    rows = e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date"), F.lpad(F.hour("ts").cast("string"), 2, "0").alias("time"),
        (F.col("user_id") % 5).cast("int").alias("strike_offset"), F.when(F.col("event_id") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
    )
    return text_dates(V.check_duplicates(rows))


DUPLICATES_SQL = """WITH r AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, hour(ts) AS time, user_id%5 AS so, event_id%2 AS ot FROM events),
f AS (SELECT symbol, year(date) AS y, month(date) AS m, count(*) - count(DISTINCT (date, time, so, ot)) AS x FROM r GROUP BY ALL)
SELECT symbol, 'duplicates' AS "check", CAST(CASE WHEN sum(x)>0 THEN 0 ELSE 1 END AS BIGINT) AS passed, CAST(CASE WHEN sum(x)>0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
  count(*) FILTER (x>0) AS n_warnings, CAST(sum(x) AS DOUBLE) AS detail FROM f GROUP BY symbol"""


def validate_portfolios(spark, sf):
    """Nations as portfolios, suppliers as strategies with shares from their balance."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("portfolio"), (F.col("n_nationkey") * 100000.0 - 200000.0).alias("total_capital"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("portfolio"), F.round(F.col("s_acctbal") / 200).alias("allocation_pct"))
    return text_dates(V.validate_portfolio(n, s))


VALIDATE_SQL = """WITH a AS (SELECT s_nationkey AS portfolio, round(s_acctbal/200) AS pct FROM supplier),
j AS (SELECT n_nationkey AS portfolio, n_nationkey*100000.0-200000.0 AS cap, count(pct) AS n, sum(pct) AS s, min(pct) AS lo FROM nation LEFT JOIN a ON a.portfolio=n_nationkey GROUP BY ALL)
SELECT CAST(portfolio AS BIGINT) AS portfolio, rule FROM (
 SELECT portfolio, 'no_strategies' AS rule FROM j WHERE n=0 UNION ALL SELECT portfolio, 'capital_not_positive' FROM j WHERE cap<=0
 UNION ALL SELECT portfolio, 'allocation_not_positive' FROM j WHERE lo<=0 UNION ALL SELECT portfolio, 'allocations_not_100' FROM j WHERE abs(s-100)>0.5)"""


def allocations(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("portfolio"), ((F.col("n_nationkey") + 1) * 100000.0).alias("total_capital"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("portfolio"), F.round(F.col("s_acctbal") / 200).alias("allocation_pct"))
    return text_dates(V.allocated_capital(n, s))


ALLOCATIONS_SQL = """SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS portfolio, round(s_acctbal/200)+0.0 AS allocation_pct, (s_nationkey+1)*100000.0::DOUBLE AS total_capital,
  round((s_nationkey+1)*100000.0::DOUBLE*round(s_acctbal/200)/100,6)+0.0 AS allocated_capital FROM supplier"""


def validate_strategies(spark, sf):
    """Configurations spread over parts: each part perturbs one rule."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("run_id"), (F.col("p_partkey") % 13).alias("k"))
    k = F.col("k")
    (run,), (one,) = strategy_rows([strategy("x", [leg("CE", **sl("points", 5))])])
    runs = p.select(*literals(run, S.RUNS)[1:], "run_id", "k").withColumns(
        {"capital": F.when(k == 1, 0.0).otherwise(F.col("capital")), "entry_time": F.when(k == 2, F.col("exit_time")).otherwise(F.col("entry_time")), "overall_sl_enabled": k == 3}
    )
    legs = p.where("k <> 4").select(*literals(one, S.LEGS)[1:], "run_id", "k").withColumns(
        {
            "lots": F.when(k == 5, 0).otherwise(F.col("lots")), "trail_sl_enabled": k.isin(6, 7), "trail_sl_mode": F.when(k == 7, "lock").otherwise("trail"),
            "trail_sl_activate_at": F.when(k == 7, 5.0).otherwise(0.0), "stop_loss_value": F.when(k == 8, 0.0).otherwise(5.0), "target_profit_enabled": k == 9,
            "reentry_mode": F.when(k == 10, "momentum_confirm").otherwise("after_n_bars"), "reentry_on_sl": k == 11,
            "reentry_cooldown_bars": F.when(k == 11, 0).otherwise(5),
        }
    )
    return text_dates(V.validate_strategies(runs, legs).select("run_id", "rule"))


STRATEGIES_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS run_id, rule FROM part JOIN (VALUES (1,'capital_not_positive'),(2,'entry_not_before_exit'),(3,'overall_stop_needs_two_legs'),
 (4,'no_legs'),(5,'lots_not_positive'),(6,'trail_without_activation'),(7,'lock_without_share'),(8,'stop_without_value'),(9,'target_without_value'),
 (10,'momentum_without_filter'),(11,'cooldown_not_positive')) v(k, rule) ON k = p_partkey % 13"""

ENTRIES = {
    "A01_A02_B01_scan_bars": (scan_bars, SCAN_SQL),
    "A03_list_available": (list_available, AVAILABLE_SQL),
    "A04_file_inventory": (file_inventory, INVENTORY_SQL),
    "A05_G05_normalize_bars": (normalize, NORMALIZE_SQL),
    "A06_A07_ingest_csv": (ingest_csv, INGEST_SQL),
    "A08_A10_stored_trades": (stored_trades, STORED_SQL),
    "A08_A10_stored_equity": (stored_equity, STORED_EQUITY_SQL),
    "A10_metrics_map": (metrics_map, MAP_SQL),
    "I09_metrics_long": (metrics_long, LONG_SQL),
    "A09_B04_safe_numbers": (safe_numbers, SAFE_SQL),
    "A11_C14_G03_B05_recent_runs": (recent_runs, RECENT_SQL),
    "A11_C14_all_runs": (all_runs, ALL_RUNS_SQL),
    "A11_strategy_runs": (strategy_runs, STRATEGY_RUNS_SQL),
    "A12_validate_strategies": (validate_strategies, STRATEGIES_SQL),
    "A13_validate_portfolios": (validate_portfolios, VALIDATE_SQL),
    "A13_allocated_capital": (allocations, ALLOCATIONS_SQL),
    "C06_lot_size_asof": (lot_size_asof, LOT_SQL),
    "C07_H08_H09_H11_expiry_asof": (expiry_asof, EXPIRY_SQL),
    "D33_expiry_gate": (expiry_gate, GATE_SQL),
    "C11_lot_coverage": (uncovered, UNCOVERED_SQL),
    "H10_H15_month_shift": (month_shift, SHIFT_SQL),
    "K01_K06_validate_bars": (checks, CHECKS_SQL),
    "K03_duplicates": (duplicates, DUPLICATES_SQL),
    "F09_G06_spot_jumps": (spot_jumps, JUMPS_SQL),
    "F11_date_gaps": (date_gaps, GAPS_SQL),
}

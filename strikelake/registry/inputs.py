"""Bars and trades derived from the driver tables, in Spark and as DuckDB text.

``events`` give option bars: users fall into symbols (75 each, so symbols grow with the
data), strikes and sides; hours are the bar times. ``lineitem`` and ``orders`` give trades of
ten runs. Money is in 1e-4 units held as whole doubles, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPITAL = 5.0e11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value").select(
        "event_id",
        "value",
        F.round(c("value") * 100).cast("bigint").alias("cents"),
        F.concat(F.lit("S"), F.floor(c("user_id") / 75).cast("bigint").cast("string")).alias("symbol"),
        c("ts").cast("date").alias("date"),
        F.concat(F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit(":00:00")).alias("time"),
        F.when(c("event_id") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        (c("user_id") % 5 - 2).cast("int").alias("strike_offset"),
    )
    chain = e.groupBy("symbol", "date", "time", "option_type", "strike_offset").agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum("cents").alias("cents"),
    )
    # One chain has at most ten contracts per bar time, so this group is bounded.
    spots = chain.groupBy("symbol", "date", "time").agg(
        (F.lit(10000) + F.sum("cents").cast("double") / F.sum("volume")).alias("spot"),
        F.collect_list(F.struct("option_type", "strike_offset", "open", "high", "low", "close", "volume", "cents")).alias("rows"),
    )
    return spots.select("symbol", "date", "time", "spot", F.inline("rows")).select(
        "symbol",
        "date",
        "time",
        "option_type",
        "strike_offset",
        "open",
        "high",
        "low",
        "close",
        "volume",
        (F.lit(15000.0) + F.lit(100.0) * c("strike_offset")).alias("strike"),
        (c("volume") * 100).cast("double").alias("oi"),
        "spot",
        ((c("cents") % 40).cast("double") / 100).alias("iv"),
    )


BARS_SQL = """
bars_e AS (
  SELECT event_id, value, CAST(round(value*100) AS BIGINT) AS cents,
         'S' || CAST(CAST(floor(user_id/75) AS BIGINT) AS VARCHAR) AS symbol,
         CAST(ts AS DATE) AS date, lpad(CAST(hour(ts) AS VARCHAR),2,'0') || ':00:00' AS time,
         CASE WHEN event_id % 2 = 0 THEN 'CE' ELSE 'PE' END AS option_type,
         CAST(user_id % 5 - 2 AS INT) AS strike_offset FROM events),
bars_s AS (
  SELECT symbol, date, time, 10000 + CAST(sum(cents) AS DOUBLE)/count(*) AS spot
  FROM bars_e GROUP BY symbol, date, time),
bars AS (
  SELECT e.symbol, e.date, e.time, option_type, strike_offset,
         min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
         max_by(value, event_id) AS close, count(*) AS volume,
         15000.0::DOUBLE + 100.0::DOUBLE * strike_offset AS strike,
         CAST(count(*) * 100 AS DOUBLE) AS oi, max(s.spot) AS spot,
         CAST(sum(cents) % 40 AS DOUBLE)/100 AS iv
  FROM bars_e e JOIN bars_s s ON e.symbol=s.symbol AND e.date=s.date AND e.time=s.time
  GROUP BY e.symbol, e.date, e.time, option_type, strike_offset)"""

# Order of trades within a run; (l_orderkey, l_linenumber) alone repeats.
TRADE_ORDER = ["exit_date", "orderkey", "linenumber", "partkey", "suppkey", "price_cents"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, c("l_orderkey") == c("o_orderkey"))
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    gross: Column = cents * (5 - F.round(c("l_discount") * 100).cast("bigint"))
    fee: Column = c("l_quantity").cast("bigint") * 4000
    return j.select(
        (c("l_suppkey") % 10).cast("int").alias("run_id"),
        c("o_orderdate").cast("date").alias("entry_date"),
        c("l_shipdate").cast("date").alias("exit_date"),
        c("l_orderkey").alias("orderkey"),
        c("l_linenumber").alias("linenumber"),
        c("l_partkey").alias("partkey"),
        c("l_suppkey").alias("suppkey"),
        cents.alias("price_cents"),
        gross.cast("double").alias("pnl_gross"),
        fee.cast("double").alias("brokerage"),
        (gross - fee).cast("double").alias("pnl_net"),
        (c("l_quantity").cast("bigint") * 100).cast("double").alias("slippage_cost"),
        (F.round(c("l_tax") * 100).cast("bigint") * 1000).cast("double").alias("stt"),
        F.when(c("l_returnflag") == "R", "stop_loss").when(c("l_returnflag") == "A", "target").otherwise("time_exit").alias("exit_reason"),
        c("l_quantity").cast("int").alias("bars_held"),
        (c("l_linenumber") - 1).cast("int").alias("reentry_attempt"),
        F.when(c("l_linestatus") == "O", "sell").otherwise("buy").alias("position_side"),
        F.when(c("l_partkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        (F.lit(15000.0) + (c("l_partkey") % 700).cast("double")).alias("entry_spot"),
        (F.lit(15000.0) + ((c("l_partkey") * 7 + c("l_orderkey")) % 700).cast("double")).alias("exit_spot"),
        (F.lit(15000.0) + F.lit(100.0) * (c("l_linenumber") - 3)).alias("strike"),
        (F.lit(0.05) + (c("l_partkey") % 40).cast("double") / 100).alias("entry_iv"),
        (F.lit(0.05) + (c("l_orderkey") % 40).cast("double") / 100).alias("exit_iv"),
        (c("l_orderkey") % 12).cast("double").alias("dte_at_entry"),
        F.greatest(F.least(F.date_diff(c("l_shipdate"), c("o_orderdate")), F.lit(5)), F.lit(0)).cast("double").alias("days_held"),
        (c("l_partkey") % 400 + 1).cast("double").alias("entry_premium"),
        ((c("l_partkey") + c("l_orderkey")) % 400 + 1).cast("double").alias("exit_premium"),
        (c("l_linenumber") % 3 + 1).cast("int").alias("lots"),
        F.lit(15).alias("lot_size"),
    )


TRADES_SQL = """
trades AS (
  SELECT CAST(l_suppkey % 10 AS INT) AS run_id,
    row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_shipdate, l_orderkey, l_linenumber,
                       l_partkey, l_suppkey, l_extendedprice) AS trade_id,
    CAST(o_orderdate AS DATE) AS entry_date, CAST(l_shipdate AS DATE) AS exit_date,
    l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
    CAST(round(l_extendedprice*100) AS BIGINT) AS price_cents,
    CAST(CAST(round(l_extendedprice*100) AS BIGINT)*(5-CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE) AS pnl_gross,
    CAST(CAST(l_quantity AS BIGINT)*4000 AS DOUBLE) AS brokerage,
    CAST(CAST(round(l_extendedprice*100) AS BIGINT)*(5-CAST(round(l_discount*100) AS BIGINT)) - CAST(l_quantity AS BIGINT)*4000 AS DOUBLE) AS pnl_net,
    CAST(CAST(l_quantity AS BIGINT)*100 AS DOUBLE) AS slippage_cost,
    CAST(CAST(round(l_tax*100) AS BIGINT)*1000 AS DOUBLE) AS stt,
    CASE l_returnflag WHEN 'R' THEN 'stop_loss' WHEN 'A' THEN 'target' ELSE 'time_exit' END AS exit_reason,
    CAST(l_quantity AS INT) AS bars_held, CAST(l_linenumber-1 AS INT) AS reentry_attempt,
    CASE WHEN l_linestatus = 'O' THEN 'sell' ELSE 'buy' END AS position_side,
    CASE WHEN l_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS option_type,
    15000.0::DOUBLE + CAST(l_partkey % 700 AS DOUBLE) AS entry_spot,
    15000.0::DOUBLE + CAST((l_partkey*7 + l_orderkey) % 700 AS DOUBLE) AS exit_spot,
    15000.0::DOUBLE + 100.0::DOUBLE * (l_linenumber - 3) AS strike,
    0.05::DOUBLE + CAST(l_partkey % 40 AS DOUBLE)/100 AS entry_iv,
    0.05::DOUBLE + CAST(l_orderkey % 40 AS DOUBLE)/100 AS exit_iv,
    CAST(l_orderkey % 12 AS DOUBLE) AS dte_at_entry,
    CAST(greatest(least(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 5), 0) AS DOUBLE) AS days_held,
    CAST(l_partkey % 400 + 1 AS DOUBLE) AS entry_premium,
    CAST((l_partkey + l_orderkey) % 400 + 1 AS DOUBLE) AS exit_premium,
    CAST(l_linenumber % 3 + 1 AS INT) AS lots, 15 AS lot_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def run_table(t: DataFrame) -> DataFrame:
    """Capital and period of the ten derived runs."""
    return t.groupBy("run_id").agg(
        F.lit(CAPITAL).alias("capital"),
        F.min("entry_date").alias("start_date"),
        F.max("exit_date").alias("end_date"),
    )


# Daily equity, series and peaks of the derived runs, shared by the metric oracles.
SERIES_SQL = """
daily AS (
  SELECT run_id, date, 5.0e11::DOUBLE + sum(day) OVER (PARTITION BY run_id ORDER BY date) AS equity
  FROM (SELECT run_id, exit_date AS date, sum(pnl_net) AS day FROM trades GROUP BY run_id, exit_date)),
series0 AS (
  SELECT *, lag(equity) OVER w AS prev_equity,
         greatest(5.0e11::DOUBLE, max(equity) OVER (PARTITION BY run_id ORDER BY date)) AS peak
  FROM daily WINDOW w AS (PARTITION BY run_id ORDER BY date)),
series AS (
  SELECT *, equity - prev_equity AS daily_pnl,
         CASE WHEN prev_equity IS NULL THEN NULL WHEN prev_equity > 0 THEN (equity-prev_equity)/prev_equity ELSE 0 END AS daily_return,
         peak - equity AS drawdown, CASE WHEN peak > 0 THEN (peak-equity)/peak*100 ELSE 0 END AS drawdown_pct
  FROM series0)"""


def text_dates(df: DataFrame, places: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Result form of a registered query: dates as text, counts as BIGINT, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "date":
            col = col.cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "boolean":
            col = col.cast("int").cast("bigint")
        elif kind in ("double", "float"):
            n = (places or {}).get(name, default)
            finite = col.isNotNull() & ~F.isnan(col) & (F.abs(col) <= F.lit(1e308))
            # Adding zero turns a negative zero into zero.
            col = F.when(finite, F.round(col.cast("double"), n) + F.lit(0.0))
        out.append(col.alias(name))
    return df.select(*out)

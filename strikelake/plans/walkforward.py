"""Walk-forward windows over trades and daily equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import shift_months
from .metrics import RF_DAILY


def wf_windows(spans: DataFrame, is_months: int = 6, oos_months: int = 2, slide_months: int = 2, by=("run_id",)) -> DataFrame:
    """In-sample and out-of-sample windows per span (start_date, end_date).

    Starts step by months with the day clamped to 28; the last out-of-sample end is not
    after the end of the span.
    """
    c = F.col
    most = F.floor(F.months_between("end_date", "start_date") / slide_months).cast("int") + 1
    w = spans.select(*by, "start_date", "end_date", F.explode(F.sequence(F.lit(0), F.greatest(most, F.lit(0)))).alias("window_id"))
    # The first window keeps its day of month; every later one has been shifted.
    w = w.withColumn("is_start", F.when(c("window_id") == 0, c("start_date")).otherwise(shift_months("start_date", c("window_id") * slide_months)))
    w = w.withColumn("is_end", shift_months("is_start", is_months)).withColumn("oos_start", c("is_end"))
    w = w.withColumn("oos_end", shift_months("oos_start", oos_months))
    return w.where(c("oos_end") <= c("end_date")).drop("start_date", "end_date")


def _days(windows: DataFrame, by) -> DataFrame:
    """One row per window, side and date: turns the range condition into an equality."""
    side = F.explode(
        F.array(
            F.struct(F.lit("is").alias("side"), F.col("is_start").alias("a"), F.col("is_end").alias("b")),
            F.struct(F.lit("oos").alias("side"), F.col("oos_start").alias("a"), F.col("oos_end").alias("b")),
        )
    ).alias("_w")
    d = windows.select(*by, "window_id", side).select(*by, "window_id", "_w.side", "_w.a", "_w.b")
    return d.select(*by, "window_id", "side", F.explode(F.sequence("a", F.date_sub("b", 1))).alias("date"))


def daily_trades(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Trades reduced to by, exit_date, n, pnl_net and the earliest entry_date: all that windows, equity and counts need."""
    return trades.groupBy(*by, "exit_date").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl_net").alias("pnl_net"), F.min("entry_date").alias("entry_date"))


def walk_forward(trades: DataFrame, equity: DataFrame, windows: DataFrame, by=("run_id",)) -> DataFrame:
    """Trades, P&L and Sharpe in and out of sample per window, and the degradation ratio.

    Trades are reduced to (run, exit date), if :func:`daily_trades` has not done so, and equity is daily before either meets the
    windows. The Sharpe here uses the population deviation of consecutive equity points.
    """
    c, by = F.col, list(by)
    days = _days(windows, by)
    per_day = trades.groupBy(*by, c("exit_date").alias("date")).agg((F.sum("n") if "n" in trades.columns else F.count(F.lit(1))).alias("n"), F.sum("pnl_net").alias("pnl"))
    t = days.join(per_day, [*by, "date"]).groupBy(*by, "window_id").pivot("side", ["is", "oos"]).agg(F.sum("n").alias("trades"), F.sum("pnl").alias("pnl"))
    e = days.join(equity.select(*by, "date", "equity"), [*by, "date"])
    w = Window.partitionBy(*by, "window_id", "side").orderBy("date")
    prev = F.lag("equity").over(w)
    ret = F.when(prev.isNull(), None).when(prev > 0, (c("equity") - prev) / F.when(prev > 0, prev)).otherwise(0.0)
    e = e.withColumn("_r", ret).groupBy(*by, "window_id", "side").agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    ratio = F.when(c("_s") > 0, (c("_m") - RF_DAILY) / F.when(c("_s") > 0, c("_s")) * F.sqrt(F.lit(252.0)))
    s = e.withColumn("_q", F.coalesce(ratio, F.lit(0.0))).groupBy(*by, "window_id").pivot("side", ["is", "oos"]).agg(F.max("_q"))
    s = s.withColumnsRenamed({"is": "is_sharpe", "oos": "oos_sharpe"})
    j = windows.join(t, [*by, "window_id"], "left").join(s, [*by, "window_id"], "left")
    for name in ("is_sharpe", "oos_sharpe", "is_pnl", "oos_pnl"):
        j = j.withColumn(name, F.coalesce(name, F.lit(0.0)))
    for name in ("is_trades", "oos_trades"):
        j = j.withColumn(name, F.coalesce(name, F.lit(0)))
    strong = F.abs(c("is_sharpe")) > 0.001
    return j.withColumn("degradation_ratio", F.when(strong, c("oos_sharpe") / F.when(strong, c("is_sharpe"))).otherwise(0.0))


def wf_summary(windows: DataFrame, by=("run_id",)) -> DataFrame:
    s = windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.avg("degradation_ratio").alias("avg_degradation"),
        (F.count_if(F.col("oos_sharpe") > 0) / F.count(F.lit(1)) * 100).alias("pct_positive_oos"),
    )
    return s.withColumn("robustness_score", F.col("avg_degradation") * F.col("pct_positive_oos") / 100)

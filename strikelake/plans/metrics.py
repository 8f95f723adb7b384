"""Performance metrics: one wide row per run.

Trades are reduced by hash aggregation with map-side partials. Everything that needs order
works on the daily series, which has one row per run and calendar day however many trades
or bars there are. Only win/loss streaks need the trade order itself; they use sampled range
blocks (:func:`strikelake.operators.ordered.streaks`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import collapse_reason, ratio_or_inf, ratio_or_zero
from ..operators.ordered import running_max, streaks

RISK_FREE = 0.065
DAYS = 252.0
RF_DAILY = RISK_FREE / DAYS


def daily_equity(equity: DataFrame, by=("run_id",)) -> DataFrame:
    """Last equity point of each date."""
    return equity.groupBy(*by, "date").agg(F.max_by("equity", F.col("ts")).alias("equity"))


def daily_equity_from_trades(trades: DataFrame, capital: Column, by=("run_id",)) -> DataFrame:
    """Realised equity per exit date: capital plus net P&L so far (days without exits have no row)."""
    days = trades.groupBy(*by, F.col("exit_date").alias("date")).agg(F.sum("pnl_net").alias("_day"))
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*by, "date", (capital + F.sum("_day").over(w)).alias("equity"))


def daily_series(daily: DataFrame, by=("run_id",), capital: Column | None = None) -> DataFrame:
    """Daily P&L, return, running peak (from ``capital``) and drawdown."""
    w = Window.partitionBy(*by).orderBy("date")
    prev = F.lag("equity").over(w)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if capital is not None:
        peak = F.greatest(capital, peak)
    df = daily.withColumn("prev_equity", prev).withColumn("peak", peak)
    p, e = F.col("prev_equity"), F.col("equity")
    return df.select(
        *daily.columns,
        "prev_equity",
        "peak",
        (e - p).alias("daily_pnl"),
        F.when(p.isNull(), None).when(p > 0, (e - p) / F.when(p > 0, p)).otherwise(0.0).alias("daily_return"),
        (F.col("peak") - e).alias("drawdown"),
        F.when(F.col("peak") > 0, (F.col("peak") - e) / F.when(F.col("peak") > 0, F.col("peak")) * 100)
        .otherwise(0.0)
        .alias("drawdown_pct"),
    )


def drawdown_curve(equity: DataFrame, capital: Column, by=("run_id",)) -> DataFrame:
    """Bar-grain peak and drawdown percent; blocks are the days."""
    df = running_max(equity, list(by), ["date"], ["ts"], F.greatest(capital, "equity"), "peak")
    pct = (F.col("peak") - F.col("equity")) / F.when(F.col("peak") > 0, F.col("peak")) * 100
    return df.withColumn("drawdown_pct", F.coalesce(pct, F.lit(0.0)))


def trade_metrics(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Counts, sums and rates over trades."""
    net, n = F.col("pnl_net"), F.count(F.lit(1))
    win, loss = net > 0, net <= 0
    reason = collapse_reason("exit_reason")
    again = F.col("reentry_attempt") > 0

    def share(cond: Column) -> Column:
        return F.count_if(cond) / n * 100.0

    sums = trades.groupBy(*by).agg(
        n.alias("total_trades"),
        F.sum("pnl_gross").alias("total_pnl_gross"),
        F.sum("pnl_net").alias("total_pnl_net"),
        F.sum("brokerage").alias("total_brokerage"),
        F.sum("slippage_cost").alias("total_slippage"),
        F.sum("stt").alias("total_stt_cost"),
        (F.sum("pnl_net") / n).alias("expectancy"),
        share(win).alias("win_rate_pct"),
        F.coalesce(F.avg(F.when(win, net)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, net)), F.lit(0.0)).alias("avg_loss"),
        F.greatest(F.max(net), F.lit(0.0)).alias("largest_win"),
        F.least(F.min(net), F.lit(0.0)).alias("largest_loss"),
        F.coalesce(F.sum(F.when(win, net)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(loss, F.abs(net))), F.lit(0.0)).alias("gross_loss"),
        F.avg("bars_held").alias("avg_hold_bars"),
        F.max("bars_held").cast("bigint").alias("max_hold_bars"),
        share(reason == "stop_loss").alias("sl_hit_rate_pct"),
        share(reason == "target").alias("target_hit_rate_pct"),
        share(reason == "time_exit").alias("time_exit_rate_pct"),
        F.count_if(again).alias("reentry_count"),
        F.count_if(again & win).alias("_re_wins"),
    )
    c = F.col
    return (
        sums.withColumn("profit_factor", ratio_or_inf(c("gross_profit"), c("gross_loss")))
        .withColumn("win_loss_ratio", ratio_or_inf(c("avg_win"), F.abs(c("avg_loss"))))
        .withColumn(
            "net_cost_ratio",
            ratio_or_zero(c("total_brokerage") * 100.0, F.abs(c("total_pnl_gross")), F.abs(c("total_pnl_gross")) > 0),
        )
        .withColumn("reentry_win_rate", ratio_or_zero(c("_re_wins") * 100.0, c("reentry_count"), c("reentry_count") > 0))
        .drop("_re_wins")
    )


def trade_streaks(trades: DataFrame, order: list, by=("run_id",)) -> DataFrame:
    s = streaks(trades.select(*by, *order, "pnl_net"), list(by), order, F.col("pnl_net") > 0)
    return s.withColumnsRenamed({"max_true": "max_consec_wins", "max_false": "max_consec_losses"})


def _sharpe(mean: Column, std: Column) -> Column:
    return F.coalesce(F.when(std > 0, (mean - RF_DAILY) / F.when(std > 0, std) * math.sqrt(DAYS)), F.lit(0.0))


def risk_metrics(series: DataFrame, by=("run_id",)) -> DataFrame:
    """Drawdown, return-distribution and tail metrics from :func:`daily_series`."""
    r, dd = F.col("daily_return"), F.col("drawdown")
    w = Window.partitionBy(*by)
    ordered = w.orderBy("date")
    ranked = Window.partitionBy(*by).orderBy(F.col("daily_pnl").asc_nulls_last(), "date")
    n_pnl = F.count("daily_pnl").over(w)

    def var_slot(p: float) -> Column:
        return F.least(F.floor(F.lit(p) * n_pnl), n_pnl - 1) + 1

    df = series.withColumn("_rank", F.row_number().over(ranked))
    df = df.withColumn("_v95", F.max(F.when(F.col("_rank") == var_slot(0.05), F.col("daily_pnl"))).over(w))
    df = df.withColumn("_v99", F.max(F.when(F.col("_rank") == var_slot(0.01), F.col("daily_pnl"))).over(w))
    # Days under water: number the recoveries, then count the days after each.
    df = df.withColumn("_under", F.col("equity") < F.col("peak"))
    df = df.withColumn(
        "_isl",
        F.sum(F.when(F.col("_under"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
    )
    df = df.withColumn("_days", F.sum(F.col("_under").cast("int")).over(Window.partitionBy(*by, "_isl")))
    down = r < RF_DAILY
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trading_days"),
        F.greatest(F.max(dd), F.lit(0.0)).alias("max_drawdown_inr"),
        F.max_by("drawdown_pct", F.struct("drawdown", (-F.unix_date("date")).alias("d"))).alias("max_drawdown_pct"),
        F.coalesce(F.avg(F.when(dd > 0, dd)), F.lit(0.0)).alias("avg_drawdown"),
        F.sqrt(F.avg(F.col("drawdown_pct") * F.col("drawdown_pct"))).alias("ulcer_index"),
        F.max("_days").cast("bigint").alias("drawdown_duration_days"),
        F.avg(r).alias("_mean"),
        F.count(r).alias("_n"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("daily_volatility"),
        F.avg(F.when(down, (r - RF_DAILY) * (r - RF_DAILY))).alias("_down2"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(r <= 0, -r).otherwise(0.0)).alias("_pain"),
        F.skewness(r).alias("_skew"),
        F.kurtosis(r).alias("_kurt"),
        F.coalesce(F.max("_v95"), F.lit(0.0)).alias("var_95"),
        F.coalesce(F.max("_v99"), F.lit(0.0)).alias("var_99"),
        F.coalesce(F.avg(F.when(F.col("daily_pnl") <= F.col("_v95"), F.col("daily_pnl"))), F.lit(0.0)).alias("cvar"),
    )
    c = F.col
    std, shrink = c("daily_volatility"), (c("_n") - 1) / c("_n")
    # A series without any variation has no shape; std 0 covers it.
    return agg.select(
        *by,
        "trading_days",
        "max_drawdown_inr",
        F.when(c("max_drawdown_inr") > 0, c("max_drawdown_pct")).otherwise(0.0).alias("max_drawdown_pct"),
        "avg_drawdown",
        "ulcer_index",
        "drawdown_duration_days",
        "daily_volatility",
        (std * math.sqrt(DAYS)).alias("ann_volatility"),
        _sharpe(c("_mean"), std).alias("sharpe_ratio"),
        _sharpe(c("_mean"), F.sqrt("_down2")).alias("sortino_ratio"),
        F.when(c("_n") == 0, 0.0).otherwise(ratio_or_inf(c("_gain"), c("_pain"))).alias("omega_ratio"),
        F.when((c("_n") >= 3) & (std > 0), c("_skew") * F.pow(shrink, F.lit(1.5))).otherwise(0.0).alias("skewness"),
        F.when((c("_n") >= 4) & (std > 0), (c("_kurt") + 3) * shrink * shrink - 3).otherwise(0.0).alias("kurtosis"),
        "var_95",
        "var_99",
        "cvar",
    )


# Order of the wide result; runs without trades carry zero in every one of these.
METRICS = """total_trades total_pnl_gross total_pnl_net total_brokerage total_slippage
    total_stt_cost roi_pct expectancy win_rate_pct avg_win avg_loss largest_win largest_loss
    gross_profit gross_loss profit_factor win_loss_ratio cagr avg_hold_bars max_hold_bars
    sl_hit_rate_pct target_hit_rate_pct time_exit_rate_pct reentry_count reentry_win_rate
    net_cost_ratio max_drawdown_inr max_drawdown_pct avg_drawdown sharpe_ratio sortino_ratio
    calmar_ratio omega_ratio var_95 var_99 cvar ulcer_index daily_volatility ann_volatility
    skewness kurtosis recovery_factor drawdown_duration_days max_consec_wins
    max_consec_losses""".split()


def run_metrics(trades: DataFrame, daily: DataFrame, runs: DataFrame, order: list) -> DataFrame:
    """All metrics per run.

    ``daily`` has (run_id, date, equity); ``runs`` has run_id, capital, start_date and
    end_date; ``order`` lists the trade-order columns after run_id.
    """
    c = F.col
    runs = runs.select("run_id", "capital", "start_date", "end_date")
    series = daily_series(
        daily.join(runs.select("run_id", "capital"), "run_id"), capital=c("capital")
    )
    wide = (
        runs.join(trade_metrics(trades), "run_id", "left")
        .join(risk_metrics(series), "run_id", "left")
        .join(trade_streaks(trades, order), "run_id", "left")
    )
    final = c("capital") + c("total_pnl_net")
    years = F.greatest(F.date_diff("end_date", "start_date"), F.lit(1)) / 365.25
    wide = (
        wide.withColumn("roi_pct", c("total_pnl_net") / c("capital") * 100)
        .withColumn("cagr", F.when(final > 0, F.pow(final / c("capital"), 1 / years) - 1).otherwise(0.0))
        .withColumn(
            "calmar_ratio", ratio_or_zero(c("cagr"), c("max_drawdown_pct") / 100, c("max_drawdown_pct") > 0)
        )
        .withColumn(
            "recovery_factor", ratio_or_zero(c("total_pnl_net"), c("max_drawdown_inr"), c("max_drawdown_inr") > 0)
        )
    )
    idle = c("total_trades").isNull()
    kinds = dict(wide.dtypes)
    filled = []
    for m in METRICS:
        zero = F.lit(0).cast(kinds[m])
        filled.append(F.when(idle, zero).otherwise(F.coalesce(c(m), zero)).alias(m))
    return wide.select("run_id", *filled)

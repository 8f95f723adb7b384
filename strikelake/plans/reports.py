"""Report rollups over trades, equity, bars and sweep results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import month_label
from ..functions.values import finite, metric_category, metric_group_order
from ..operators.ordered import ordinal


def monthly_pnl(trades: DataFrame, by=("run_id",)) -> DataFrame:
    m = trades.groupBy(*by, F.year("exit_date").alias("year"), F.month("exit_date").alias("month")).agg(F.sum("pnl_net").alias("pnl"))
    return m.withColumn("label", month_label("year", "month"))


def monthly_grid(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Years down, months across; empty months are 0."""
    m = monthly_pnl(trades, by)
    return m.groupBy(*by, "year").pivot("month", list(range(1, 13))).agg(F.sum("pnl")).na.fill(0.0)


def daily_pnl(trades: DataFrame, by=("run_id",)) -> DataFrame:
    return trades.groupBy(*by, F.col("exit_date").alias("date")).agg(F.sum("pnl_net").alias("pnl"), F.count(F.lit(1)).alias("trades"))


def pnl_histogram(trades: DataFrame, bins: int = 20, by=("run_id",)) -> DataFrame:
    """Equal bins between the smallest and largest net P&L of a run; empty bins are listed."""
    limits = trades.groupBy(*by).agg(F.min("pnl_net").alias("low"), F.max("pnl_net").alias("high"))
    limits = limits.withColumn("width", F.greatest(F.col("high") - F.col("low"), F.lit(1.0)) / bins)
    slot = F.least(F.lit(bins - 1), F.floor((F.col("pnl_net") - F.col("low")) / F.col("width"))).cast("int")
    counts = trades.select(*by, "pnl_net").join(limits, list(by)).groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    frame = limits.select(*by, "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"), F.coalesce("_n", F.lit(0)).alias("count")
    )


def heatmap_cells(results: DataFrame, x: str, y: str) -> DataFrame:
    """One cell per combination that sets both parameters; ``params`` is a map."""
    cell = results.select(
        F.try_element_at("params", F.lit(x)).alias("x"), F.try_element_at("params", F.lit(y)).alias("y"),
        F.coalesce("sharpe_ratio", F.lit(0.0)).alias("sharpe"), F.coalesce("total_pnl_net", F.lit(0.0)).alias("pnl"),
        F.coalesce("total_trades", F.lit(0)).alias("trades"), "combo_index",
    )
    return cell.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def heatmap_grid(cells: DataFrame, values: list[float], measure: str = "sharpe") -> DataFrame:
    """Pivot of the cells: y down, the given x values across, the best cell each."""
    return cells.groupBy("y").pivot("x", values).agg(F.max(measure))


def greeks_totals(attributed: DataFrame, by=("run_id",)) -> DataFrame:
    """Total delta, theta, vega and gamma P&L in long form."""
    names = ["delta", "theta", "vega", "gamma"]
    wide = attributed.groupBy(*by).agg(*[F.sum(f"{n}_pnl").alias(n) for n in names])
    return wide.unpivot(list(by), names, "greek", "pnl")


def data_summary(bars: DataFrame, trading_days: DataFrame | None = None) -> DataFrame:
    """Bar count, days, dates, IV coverage, zero-volume share and missing weekdays per symbol.

    Missing days are counted against ``trading_days`` (date), or all Mondays to Fridays
    between a symbol's first and last date.
    """
    days = bars.select("symbol", "date").distinct()
    s = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("date").alias("date_from"), F.max("date").alias("date_to"),
        F.round(F.count_if(F.col("iv") > 0) / F.count(F.lit(1)) * 100).cast("bigint").alias("iv_coverage"),
        F.round(F.count_if(F.col("volume") == 0) / F.count(F.lit(1)) * 100, 1).alias("zero_volume_pct"),
    )
    n = days.groupBy("symbol").agg(F.count(F.lit(1)).alias("trading_days"))
    span = s.select("symbol", F.explode(F.sequence("date_from", "date_to")).alias("date"))
    if trading_days is None:
        span = span.where(F.weekday("date") < 5)
    else:
        span = span.join(trading_days.select("date").distinct(), "date", "left_semi")
    missing = span.join(days, ["symbol", "date"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("_m"))
    return (
        s.join(n, "symbol").join(missing, "symbol", "left")
        .withColumn("missing_days", F.coalesce("_m", F.lit(0))).drop("_m")
    )


def options_metrics(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Premium capture, theta, IV and days-to-expiry figures, and greeks P&L totals."""
    c, n = F.col, F.count(F.lit(1))
    sold = c("position_side") == "sell"

    def of_sold(name: str) -> Column:
        return F.coalesce(F.sum(F.when(sold, c(name))), F.lit(0.0))

    def share(cond: Column) -> Column:
        return F.count_if(cond) / n * 100

    d = c("dte_at_entry")
    a = trades.groupBy(*by).agg(
        of_sold("entry_premium").alias("_in"), of_sold("exit_premium").alias("_out"),
        of_sold("theta_pnl").alias("total_theta_collected"), of_sold("days_held").alias("_days"),
        F.avg("entry_iv").alias("avg_iv_at_entry"), F.avg("exit_iv").alias("avg_iv_at_exit"),
        F.avg("delta_at_entry").alias("avg_net_delta"),
        F.avg(d).alias("avg_dte"), F.min(d).alias("min_dte"), F.greatest(F.max(d), F.lit(0.0)).alias("max_dte"),
        share(d < 3).alias("pct_below_3"), share((d >= 3) & (d <= 7)).alias("pct_3_to_7"), share(d > 7).alias("pct_above_7"),
        *[F.sum(f"{g}_pnl").alias(f"total_{g}_pnl") for g in ("delta", "gamma", "theta", "vega")],
    )

    def per(num: Column, den: Column) -> Column:
        return F.coalesce(F.when(den > 0, num / F.when(den > 0, den)), F.lit(0.0))

    return a.select(
        *by,
        per((c("_in") - c("_out")) * 100, c("_in")).alias("premium_capture_pct"),
        "total_theta_collected",
        per(c("total_theta_collected"), c("_days")).alias("avg_theta_per_day"),
        "avg_iv_at_entry", "avg_iv_at_exit",
        per((c("avg_iv_at_entry") - c("avg_iv_at_exit")) * 100, c("avg_iv_at_entry")).alias("iv_crush_pct"),
        "avg_net_delta", "avg_dte", "min_dte", "max_dte", "pct_below_3", "pct_3_to_7", "pct_above_7",
        *[f"total_{g}_pnl" for g in ("delta", "gamma", "theta", "vega")],
    )


def categorized(long: DataFrame) -> DataFrame:
    """Long metrics with their report category and its place."""
    m = long.withColumn("category", metric_category("metric_name"))
    return m.withColumn("category_order", metric_group_order("category"))


def downsample(df: DataFrame, max_points: int, by=("run_id",), block="date", order=("ts",)) -> DataFrame:
    """Every step-th row per key so that about ``max_points`` remain; short series stay whole."""
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    numbered = ordinal(df, list(by), [block], list(order), "_ord").join(totals, list(by))
    step = F.when(F.col("_total") <= max_points, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("_total") / max_points)))
    return numbered.where((F.col("_ord") - 1) % step == 0).drop("_ord", "_total")


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[float], rounded: bool = True, order=()) -> DataFrame:
    """Percentiles by rank: index round(p/100*(n-1)), or truncated when ``rounded`` is false.

    Meant for groups of bounded size (simulations, days).
    """
    w = Window.partitionBy(*by)
    df = df.withColumn("_rk", F.row_number().over(w.orderBy(value, *order))).withColumn("_n", F.count(F.lit(1)).over(w))

    def slot(p: float) -> Column:
        # Half away from zero, as the index is never negative.
        x = F.lit(p / 100.0) * (F.col("_n") - 1)
        return (F.floor(x + 0.5) if rounded else F.floor(x)) + 1

    return df.groupBy(*by).agg(*[F.max(F.when(F.col("_rk") == slot(p), F.col(value))).alias(f"p{p:g}") for p in percents])


def dashboard_totals(metrics: DataFrame) -> DataFrame:
    """Best Sharpe and total P&L over runs with finite values."""
    return metrics.agg(
        F.max(F.when(finite("sharpe_ratio"), F.col("sharpe_ratio"))).alias("best_sharpe"),
        F.coalesce(F.sum(F.when(finite("total_pnl_net"), F.col("total_pnl_net"))), F.lit(0.0)).alias("total_pnl"),
        F.count(F.lit(1)).alias("runs"),
    )


def period_profile(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Best and worst month, and the share of profitable months and weeks."""
    m = monthly_pnl(trades, by).groupBy(*by).agg(
        F.max("pnl").alias("best_month"), F.min("pnl").alias("worst_month"), F.avg("pnl").alias("avg_monthly_pnl"),
        (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("pct_profitable_months"),
    )
    weeks = trades.groupBy(*by, F.date_trunc("week", "exit_date").alias("week")).agg(F.sum("pnl_net").alias("pnl"))
    w = weeks.groupBy(*by).agg((F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("pct_profitable_weeks"))
    return m.join(w, list(by))


def day_of_week_pnl(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Net P&L, trades and win rate by weekday of exit (0 = Monday)."""
    return trades.groupBy(*by, F.weekday("exit_date").alias("weekday")).agg(
        F.sum("pnl_net").alias("pnl"), F.count(F.lit(1)).alias("trades"),
        (F.count_if(F.col("pnl_net") > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
    )


def expiry_day_performance(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Trades entered on expiry day against all others (needs dte_at_entry)."""
    return trades.groupBy(*by, (F.col("dte_at_entry") <= 0).alias("on_expiry")).agg(
        F.sum("pnl_net").alias("pnl"), F.count(F.lit(1)).alias("trades"),
        (F.count_if(F.col("pnl_net") > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
    )


def rolling_sharpe(series: DataFrame, days: int = 365, by=("run_id",)) -> DataFrame:
    """Annualised Sharpe of the daily returns of the last ``days`` calendar days."""
    w = Window.partitionBy(*by).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    sd = F.stddev_samp("daily_return").over(w)
    ratio = (F.avg("daily_return").over(w) - 0.065 / 252.0) / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0))
    return series.select(*by, "date", F.coalesce(ratio, F.lit(0.0)).alias("rolling_sharpe"))


def regime_performance(trades: DataFrame, regime: Column, by=("run_id",)) -> DataFrame:
    """P&L by a regime label of the trade, such as an IV band or a trend."""
    return trades.groupBy(*by, regime.alias("regime")).agg(
        F.sum("pnl_net").alias("pnl"), F.count(F.lit(1)).alias("trades"),
        (F.count_if(F.col("pnl_net") > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
    )

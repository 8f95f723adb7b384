"""Safe numbers and small label rules (all Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leading(c: Column | str) -> Column:
    """Double of a number, or of the number a text begins with."""
    v = F.col(c) if isinstance(c, str) else c
    begun = F.regexp_extract(v.cast("string"), r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(v.try_cast("double"), begun.try_cast("double"))


def safe_num(c: Column | str) -> Column:
    """Double, or NULL for NaN, infinities, beyond 1e308 and text that begins with no number."""
    d = _leading(c)
    return F.when(F.isnan(d) | (F.abs(d) > F.lit(1e308)), None).otherwise(d)


def safe_int(c: Column | str) -> Column:
    """Integer part, 0 when absent or when a text begins with no number."""
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(v.try_cast("bigint"), _leading(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def collapse_reason(reason: Column | str) -> Column:
    """Six exit reasons to the four that metrics distinguish."""
    r = F.col(reason) if isinstance(reason, str) else reason
    return (
        F.when(r == "combined_sl", "stop_loss").when(r == "combined_target", "target").otherwise(r)
    )


def cost_total(*costs: str) -> Column:
    """Sum of cost columns, counting an absent or non-numeric one as zero."""
    total = F.lit(0.0)
    for c in costs:
        total = total + F.coalesce(safe_num(c), F.lit(0.0))
    return total


def valid_iv(iv: Column | str) -> Column:
    v = F.col(iv) if isinstance(iv, str) else iv
    return v.isNotNull() & (v > 0) & ~F.isnan(v) & (v < F.lit(float("inf")))


def finite(c: Column | str) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def ratio_or_inf(num: Column, den: Column) -> Column:
    """num/den, +Infinity when the denominator is not positive."""
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(float("inf")))


def ratio_or_zero(num: Column, den: Column, when: Column) -> Column:
    return F.coalesce(F.when(when, F.try_divide(num, den)), F.lit(0.0))


# The report category of each metric, in display order.
METRIC_CATEGORIES = {
    "return": """total_pnl_gross total_pnl_net cagr roi_pct expectancy profit_factor
        win_rate_pct avg_win avg_loss win_loss_ratio largest_win largest_loss gross_profit
        gross_loss payoff_ratio avg_trade_pnl median_trade_pnl best_month worst_month
        avg_monthly_return""".split(),
    "risk": """max_drawdown_inr max_drawdown_pct avg_drawdown sharpe_ratio sortino_ratio
        calmar_ratio omega_ratio var_95 var_99 cvar ulcer_index daily_volatility ann_volatility
        skewness kurtosis recovery_factor drawdown_duration_days max_drawdown_duration_days
        information_ratio treynor_ratio downside_deviation tail_ratio gain_to_pain_ratio""".split(),
    "trade": """total_trades winning_trades losing_trades avg_hold_bars max_hold_bars
        min_hold_bars max_consec_wins max_consec_losses sl_hit_rate_pct target_hit_rate_pct
        time_exit_rate_pct reentry_count reentry_win_rate avg_bars_in_winners avg_bars_in_losers
        long_count short_count long_win_rate short_win_rate""".split(),
    "cost": """total_brokerage total_slippage total_stt_cost total_other_charges
        net_cost_ratio cost_per_trade gross_to_net_ratio""".split(),
    "options": """premium_capture_pct total_theta_collected avg_theta_per_day avg_iv_at_entry
        avg_iv_at_exit iv_crush_pct avg_net_delta avg_dte min_dte max_dte pct_below_3
        pct_3_to_7 pct_above_7""".split(),
    "greeks": "total_delta_pnl total_gamma_pnl total_theta_pnl total_vega_pnl".split(),
}


def metric_category(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    label = F.lit("other")
    for category, names in reversed(METRIC_CATEGORIES.items()):
        label = F.when(n.isin(names), category).otherwise(label)
    return label


def metric_group_order(category: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    place = F.array_position(F.array(*[F.lit(k) for k in METRIC_CATEGORIES]), c).cast("int")
    return F.when(place > 0, place - 1).otherwise(F.lit(len(METRIC_CATEGORIES)))

"""Fixed schemas of the stored tables and of the strategy configuration."""

from __future__ import annotations

from pyspark.sql import types as T


BARS = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("time", T.StringType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("option_type", T.StringType()),
        T.StructField("strike_label", T.StringType()),
        T.StructField("strike_offset", T.IntegerType()),
        T.StructField("moneyness", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("oi", T.DoubleType()),
        T.StructField("spot", T.DoubleType()),
        T.StructField("iv", T.DoubleType()),
    ]
)

BAR_PARTITIONS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("expiry_type", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("entry_time", T.StringType()),
        T.StructField("exit_time", T.StringType()),
        T.StructField("expiry_filter", T.StringType()),
        T.StructField("trade_on_expiry", T.BooleanType()),
        T.StructField("max_concurrent_trades", T.IntegerType()),
        T.StructField("capital", T.DoubleType()),
        T.StructField("lot_size", T.IntegerType()),
        T.StructField("brokerage_per_lot", T.DoubleType()),
        T.StructField("slippage_model", T.StringType()),
        T.StructField("slippage_value", T.DoubleType()),
        T.StructField("stt_on_sell", T.BooleanType()),
        T.StructField("overall_sl_enabled", T.BooleanType()),
        T.StructField("overall_sl_type", T.StringType()),
        T.StructField("overall_sl_value", T.DoubleType()),
        T.StructField("overall_target_enabled", T.BooleanType()),
        T.StructField("overall_target_type", T.StringType()),
        T.StructField("overall_target_value", T.DoubleType()),
    ]
)

LEGS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("leg_no", T.IntegerType()),
        T.StructField("option_type", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("lots", T.IntegerType()),
        T.StructField("expiry", T.StringType()),
        T.StructField("strike_mode", T.StringType()),
        T.StructField("strike_offset", T.IntegerType()),
        T.StructField("delta_target", T.DoubleType()),
        T.StructField("premium_target", T.DoubleType()),
        T.StructField("stop_loss_enabled", T.BooleanType()),
        T.StructField("stop_loss_type", T.StringType()),
        T.StructField("stop_loss_value", T.DoubleType()),
        T.StructField("target_profit_enabled", T.BooleanType()),
        T.StructField("target_profit_type", T.StringType()),
        T.StructField("target_profit_value", T.DoubleType()),
        T.StructField("trail_sl_enabled", T.BooleanType()),
        T.StructField("trail_sl_activate_at", T.DoubleType()),
        T.StructField("trail_sl_lock_in", T.DoubleType()),
        T.StructField("trail_sl_mode", T.StringType()),
        T.StructField("trail_sl_unit", T.StringType()),
        T.StructField("trail_sl_value", T.DoubleType()),
        T.StructField("reentry_on_sl", T.BooleanType()),
        T.StructField("reentry_on_target", T.BooleanType()),
        T.StructField("reentry_mode", T.StringType()),
        T.StructField("reentry_cooldown_bars", T.IntegerType()),
        T.StructField("reentry_max_attempts", T.IntegerType()),
        T.StructField("momentum_filter_enabled", T.BooleanType()),
    ]
)

# Defaults of optional configuration fields.
RUN_DEFAULTS = {
    "name": "",
    "expiry_filter": "weekly",
    "trade_on_expiry": True,
    "max_concurrent_trades": 1,
    "lot_size": None,
    "brokerage_per_lot": 40.0,
    "slippage_model": "none",
    "slippage_value": 0.0,
    "stt_on_sell": True,
    "overall_sl_enabled": False,
    "overall_sl_type": "none",
    "overall_sl_value": 0.0,
    "overall_target_enabled": False,
    "overall_target_type": "none",
    "overall_target_value": 0.0,
}
LEG_DEFAULTS = {
    "lots": 1,
    "expiry": None,
    "strike_mode": "atm_offset",
    "strike_offset": 0,
    "delta_target": None,
    "premium_target": None,
    "stop_loss_enabled": False,
    "stop_loss_type": "none",
    "stop_loss_value": 0.0,
    "target_profit_enabled": False,
    "target_profit_type": "none",
    "target_profit_value": 0.0,
    "trail_sl_enabled": False,
    "trail_sl_activate_at": 0.0,
    "trail_sl_lock_in": 0.0,
    "trail_sl_mode": "trail",
    "trail_sl_unit": "percent",
    "trail_sl_value": 0.0,
    "reentry_on_sl": False,
    "reentry_on_target": False,
    "reentry_mode": "after_n_bars",
    "reentry_cooldown_bars": 5,
    "reentry_max_attempts": 2,
    "momentum_filter_enabled": False,
}

# The words allowed in enumerated fields.
ALLOWED = {
    "option_type": {"CE", "PE"},
    "position": {"buy", "sell"},
    "strike_mode": {"atm_offset", "delta", "premium", "percent_otm"},
    "stop_type": {
        "points",
        "percent_of_premium",
        "percent_of_margin",
        "index_points",
        "delta_breach",
        "combined_premium",
        "none",
    },
    "slippage_model": {"none", "fixed_pts", "percent", "volume_based"},
    "trail_sl_mode": {"lock", "trail"},
    "trail_sl_unit": {"points", "percent"},
    "reentry_mode": {"asap", "same_time", "after_n_bars", "momentum_confirm"},
}

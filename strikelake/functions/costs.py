"""Slippage, brokerage, transaction tax and exchange charges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statutory and exchange rates as fractions of premium turnover.
STT_RATE = 0.000625
EXCHANGE_RATE = 0.00053
SEBI_RATE = 0.000001
STAMP_RATE = 0.00003
GST_RATE = 0.18


def direction(side: Column) -> Column:
    return F.when(side == "buy", 1.0).otherwise(-1.0)


def opposite(side: Column) -> Column:
    return F.when(side == "buy", "sell").otherwise("buy")


def slippage(price: Column, side: Column, model: Column, value: Column) -> Column:
    """Fill price after slippage; a sale never fills below 0.01 in fixed points."""
    sells = side == "sell"
    fixed = F.when(sells, F.greatest(price - value, F.lit(0.01))).otherwise(price + value)
    pct = F.when(sells, price * (1 - value / 100)).otherwise(price * (1 + value / 100))
    return F.when(model == "fixed_pts", fixed).when(model == "percent", pct).otherwise(price)


def brokerage(per_lot: Column, lots: Column) -> Column:
    return per_lot * lots * 2.0


def stt(sell_price: Column, quantity: Column, enabled: Column) -> Column:
    return F.when(enabled, sell_price * quantity * STT_RATE).otherwise(0.0)


def _one_way(price: Column, quantity: Column, broker: Column, is_buy: Column) -> Column:
    turnover = price * quantity
    exchange = turnover * EXCHANGE_RATE
    sebi = turnover * SEBI_RATE
    stamp = F.when(is_buy, turnover * STAMP_RATE).otherwise(0.0)
    return exchange + sebi + stamp + (broker + exchange + sebi) * GST_RATE


def charges(entry: Column, exit_: Column, quantity: Column, broker_both: Column, side: Column) -> Column:
    """Round trip; stamp duty falls on whichever fill is the purchase."""
    half = broker_both / 2.0
    bought_first = side == "buy"
    return _one_way(entry, quantity, half, bought_first) + _one_way(exit_, quantity, half, ~bought_first)


def slippage_cost(entry: Column, exit_: Column, model: Column, value: Column, quantity: Column) -> Column:
    """Reported only: the fills already contain it."""
    pct = entry * (value / 100) * quantity + exit_ * (value / 100) * quantity
    return (
        F.when(model == "fixed_pts", value * quantity * 2.0)
        .when(model == "percent", pct)
        .otherwise(0.0)
    )

"""Black-Scholes prices, greeks, P&L attribution and margin as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RISK_FREE = 0.065
DAYS_PER_YEAR = 365.25

# Rational approximation of the normal distribution function, from West,
# "Better approximations to cumulative normal functions" (2005), highest power first.
CDF_NUMERATOR = [
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
CDF_DENOMINATOR = [
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
CDF_SPLIT = 7.07106781186547
CDF_TAIL = 2.506628274631


def _horner(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def norm_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-(a * a) / 2)
    body = e * _horner(CDF_NUMERATOR, a) / _horner(CDF_DENOMINATOR, a)
    tail = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / CDF_TAIL
    upper = F.when(a > 37, 0.0).when(a < CDF_SPLIT, body).otherwise(tail)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def bs_columns(
    df: DataFrame,
    spot: Column,
    strike: Column,
    tte: Column,
    iv: Column,
    option_type: Column,
    prefix: str = "",
    rate: float = RISK_FREE,
) -> DataFrame:
    """Add price, delta, gamma, theta (per day) and vega (per IV point).

    Steps are separate projections so that d1, d2 and the distribution values are each
    computed once per row. The distribution function is a lambda over (d1, d2), which Spark evaluates
    apart from the generated code: written out twice it makes a method of more than 8,000 bytes,
    which the JVM never compiles. Expired options get intrinsic value and a step delta.
    """
    live = (tte > 0) & (iv > 0) & (spot > 0) & (strike > 0)
    root = F.sqrt(tte)
    d1 = (F.ln(spot / strike) + (F.lit(rate) + iv * iv / 2) * tte) / (iv * root)
    call = option_type == "CE"
    df = df.withColumn("_d1", F.when(live, d1))
    df = df.withColumn("_d2", F.col("_d1") - F.when(live, iv * root))
    df = (
        df.withColumn("_n", F.transform(F.array("_d1", "_d2"), norm_cdf))
        .withColumn("_n1", F.get("_n", F.lit(0)))
        .withColumn("_n2", F.get("_n", F.lit(1)))
        .withColumn("_pdf", norm_pdf(F.col("_d1")))
        .withColumn("_disc", F.exp(-F.lit(rate) * tte))
    )
    n1, n2, pdf, disc = (F.col(c) for c in ("_n1", "_n2", "_pdf", "_disc"))
    m1, m2 = 1 - n1, 1 - n2
    decay = -(spot * pdf * iv) / (2 * root)
    carry = F.lit(rate) * strike * disc
    price = F.when(call, spot * n1 - strike * disc * n2).otherwise(strike * disc * m2 - spot * m1)
    delta = F.when(call, n1).otherwise(n1 - 1)
    theta = F.when(call, decay - carry * n2).otherwise(decay + carry * m2) / DAYS_PER_YEAR
    gone = F.when(call, F.greatest(spot - strike, F.lit(0.0))).otherwise(F.greatest(strike - spot, F.lit(0.0)))
    step = F.when(call, F.when(spot > strike, 1.0).otherwise(0.0)).otherwise(
        F.when(spot < strike, -1.0).otherwise(0.0)
    )
    known = option_type.isin("CE", "PE")
    out = df.select(
        "*",
        F.when(known, F.when(live, price).when(tte <= 0, gone)).alias(f"{prefix}price"),
        F.when(known, F.when(live, delta).when(tte <= 0, step)).alias(f"{prefix}delta"),
        F.when(known, F.when(live, pdf / (spot * iv * root)).when(tte <= 0, 0.0)).alias(f"{prefix}gamma"),
        F.when(known, F.when(live, theta).when(tte <= 0, 0.0)).alias(f"{prefix}theta"),
        F.when(known, F.when(live, spot * pdf * root / 100).when(tte <= 0, 0.0)).alias(f"{prefix}vega"),
    )
    return out.drop("_d1", "_d2", "_n", "_n1", "_n2", "_pdf", "_disc")


def with_greeks(
    df: DataFrame,
    spot: str = "spot",
    strike: str = "strike",
    iv: str = "iv",
    dte: str = "dte",
    option_type: str = "option_type",
) -> DataFrame:
    """Guarded greeks: any non-positive input or unknown type gives zeros."""
    kept = df.columns
    s, k, v, d = (F.col(c).cast("double") for c in (spot, strike, iv, dte))
    ok = (s > 0) & (k > 0) & (v > 0) & (d > 0) & F.col(option_type).isin("CE", "PE")
    priced = bs_columns(df, s, k, d / DAYS_PER_YEAR, v, F.col(option_type), prefix="_g_")
    return priced.select(
        *kept,
        *[F.when(ok, F.col(f"_g_{g}")).otherwise(0.0).alias(g) for g in ("delta", "gamma", "theta", "vega")],
    )


def pnl_attribution(trades: DataFrame) -> DataFrame:
    """Split each trade's P&L into delta, gamma, theta and vega parts at entry greeks.

    Needs entry/exit spot and iv, strike, dte_at_entry, days_held, option_type,
    position_side, lots, lot_size and actual_pnl.
    """
    kept = trades.columns
    c = F.col
    df = bs_columns(
        trades,
        c("entry_spot"),
        c("strike"),
        c("dte_at_entry") / DAYS_PER_YEAR,
        c("entry_iv"),
        c("option_type"),
        prefix="_a_",
    )
    known = c("option_type").isin("CE", "PE")
    sign = F.when(c("position_side") == "buy", 1.0).otherwise(-1.0)
    qty = (c("lots") * c("lot_size")).cast("double")
    move = c("exit_spot") - c("entry_spot")
    parts = {
        "delta_pnl": sign * c("_a_delta") * move * qty,
        "gamma_pnl": sign * 0.5 * c("_a_gamma") * move * move * qty,
        "theta_pnl": sign * c("_a_theta") * c("days_held") * qty,
        "vega_pnl": sign * c("_a_vega") * (c("exit_iv") - c("entry_iv")) * 100.0 * qty,
    }
    df = df.select(*kept, *[F.coalesce(F.when(known, e), F.lit(0.0)).alias(n) for n, e in parts.items()])
    df = df.withColumn("total_attributed", c("delta_pnl") + c("gamma_pnl") + c("theta_pnl") + c("vega_pnl"))
    df = df.withColumn("unexplained", c("actual_pnl") - c("total_attributed"))
    size = F.abs(c("actual_pnl"))
    error = F.when(size > 0.001, F.abs(c("unexplained")) / F.when(size > 0.001, size) * 100).otherwise(0.0)
    return df.withColumn("attribution_error_pct", F.when(known, error).otherwise(100.0))


def attribution_summary(attributed: DataFrame, by: list[str]) -> DataFrame:
    return attributed.groupBy(*by).agg(
        F.sum("delta_pnl").alias("total_delta_pnl"),
        F.sum("gamma_pnl").alias("total_gamma_pnl"),
        F.sum("theta_pnl").alias("total_theta_pnl"),
        F.sum("vega_pnl").alias("total_vega_pnl"),
        F.sum("unexplained").alias("total_unexplained"),
        F.avg("attribution_error_pct").alias("avg_attribution_error_pct"),
    )


def leg_margin(premium: Column, spot: Column, quantity: Column, factor: float = 1.0) -> Column:
    return F.greatest(premium * quantity * 3.0, spot * quantity * factor * 0.12)


def margin_rule(premium: Column, spot: Column, quantity: Column, factor: float = 1.0) -> Column:
    return F.when(premium * quantity * 3.0 >= spot * quantity * factor * 0.12, "three_x_premium").otherwise(
        "notional_percent"
    )


def strategy_margin(legs: DataFrame, by: list[str], margin: str = "leg_margin", side: str = "position_side") -> DataFrame:
    """Sum of leg margins, less 30% when bought and sold legs are both present."""
    hedged = F.bool_or(F.col(side) == "buy") & F.bool_or(F.col(side) == "sell")
    return legs.groupBy(*by).agg(
        (F.sum(margin) * F.when(hedged, 0.7).otherwise(1.0)).alias("strategy_margin")
    )

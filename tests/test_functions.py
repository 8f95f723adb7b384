import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from strikelake import calendars
from strikelake.functions import costs, pricing, values
from strikelake.operators import asof
from strikelake.operators.signals import ema, ema_cross_signal, range_breakout_signal, rsi_signal, supertrend_signal
from strikelake.operators.surface import iv_at, iv_surface


def test_norm_cdf(spark):
    xs = [i / 7 for i in range(-60, 61)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", pricing.norm_cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-14)


def test_prices_and_parity(spark):
    rows = [(k, 48000.0, 7 / 365.25, 0.15, t) for k in (47000.0, 48000.0, 49000.0) for t in ("CE", "PE")] + [(47800.0, 48000.0, 0.0, 0.15, t) for t in ("CE", "PE")]
    df = spark.createDataFrame(rows, "strike double, spot double, tte double, iv double, option_type string")
    c = F.col
    got = {(r.strike, r.option_type): r for r in pricing.bs_columns(df, c("spot"), c("strike"), c("tte"), c("iv"), c("option_type")).collect()}
    atm_c, atm_p = got[(48000.0, "CE")], got[(48000.0, "PE")]
    assert 100 < atm_c.price < 600 and 50 < atm_p.price < 400 and 0.49 < atm_c.delta < 0.55
    assert atm_c.gamma == atm_p.gamma and atm_c.vega == atm_p.vega and atm_c.theta < 0
    for k in (47000.0, 48000.0, 49000.0):
        gap = got[(k, "CE")].price - got[(k, "PE")].price
        assert gap == pytest.approx(48000 - k * math.exp(-0.065 * 7 / 365.25), rel=1e-9, abs=1e-6)
    assert (got[(47800.0, "CE")].price, got[(47800.0, "PE")].price) == (200, 0)


def test_guarded_greeks(spark):
    df = spark.createDataFrame([(0.0, 5.0, "CE"), (0.2, 0.0, "CE"), (0.2, 5.0, "XX")], "iv double, dte double, option_type string")
    df = df.withColumns({"spot": F.lit(100.0), "strike": F.lit(100.0)})
    assert all((r.delta, r.gamma, r.theta, r.vega) == (0, 0, 0, 0) for r in pricing.with_greeks(df).collect())


def test_attribution(spark):
    rows = [("CE", "buy", 48000.0, 48200.0, 1500.0), ("PE", "sell", 48000.0, 48200.0, 900.0), ("XX", "buy", 48000.0, 48200.0, 900.0)]
    df = spark.createDataFrame(rows, "option_type string, position_side string, entry_spot double, exit_spot double, actual_pnl double")
    df = df.withColumns({k: F.lit(v) for k, v in dict(strike=48000.0, entry_iv=0.15, exit_iv=0.16, dte_at_entry=5.0, days_held=1.0, lots=1, lot_size=15).items()})
    for r in pricing.pnl_attribution(df).collect():
        if r.option_type == "XX":
            assert r.attribution_error_pct == 100 and r.unexplained == r.actual_pnl
        else:
            assert r.delta_pnl > 0
            assert r.delta_pnl + r.gamma_pnl + r.theta_pnl + r.vega_pnl + r.unexplained == pytest.approx(r.actual_pnl)


def test_costs(spark):
    one = spark.range(1)
    s, m, f, p = F.lit("sell"), F.lit("fixed_pts"), F.lit, F.lit("percent")
    r = one.select(
        costs.slippage(f(200.0), s, m, f(1.0)).alias("a"), costs.slippage(f(200.0), F.lit("buy"), m, f(1.0)).alias("b"),
        costs.slippage(f(200.0), s, p, f(1.0)).alias("c"), costs.slippage(f(0.5), s, m, f(5.0)).alias("d"),
        costs.brokerage(f(40.0), f(1)).alias("e"), costs.brokerage(f(40.0), f(2)).alias("g"),
        pricing.leg_margin(f(200.0), f(45000.0), f(15.0)).alias("h"), pricing.leg_margin(f(5000.0), f(100.0), f(15.0)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.g) == (199, 201, 198, 0.01, 80, 160)
    assert (r.h, r.i) == (pytest.approx(81000), 225000)


def test_safe_values(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("-Infinity",), ("12abc",), ("12.7x",)], "t string")
    assert [r[0] for r in df.select(values.safe_num("t")).collect()] == [1.5, None, None, None, None, 12.0, 12.7]
    assert [r[0] for r in df.select(values.safe_int("t")).collect()][-2:] == [12, 12]
    assert [r[0] for r in df.select(values.safe_int("t")).collect()][:3] == [1, 0, 0]


def test_calendars(spark):
    asked = [("BANKNIFTY", "2023-08-28"), ("BANKNIFTY", "2024-01-08"), ("BANKNIFTY", "2024-12-05"), ("banknifty", "2024-11-13"), ("BANKNIFTY", "2024-11-14"),
             ("NIFTY", "2024-04-25"), ("NIFTY", "2024-04-26"), ("NIFTY", "2024-11-20"), ("SENSEX", "2024-11-19"), ("NONE", "2024-01-01"), ("BANKNIFTY", "2024-12-26")]
    df = spark.createDataFrame([(s, dt.date.fromisoformat(d)) for s, d in asked], "symbol string, date date")
    e = {(r.symbol, str(r.date)): r for r in asof.expiry_asof(df, calendars.expiry_rules(spark)).collect()}
    assert (str(e[asked[0]].expiry_date), e[asked[0]].dte) == ("2023-08-31", 3)
    assert (str(e[asked[1]].expiry_date), e[asked[1]].dte) == ("2024-01-10", 2)
    assert (str(e[asked[2]].expiry_date), e[asked[2]].expiry_type) == ("2024-12-25", "monthly")
    assert e[asked[3]].expiry_type == "weekly" and e[asked[4]].expiry_type == "monthly"
    assert str(e[asked[10]].expiry_date) == "2025-01-29"
    assert e[asked[9]].expiry_date is None
    lots = {(r.symbol, str(r.date)): r.lot_size for r in asof.lot_size_asof(df, calendars.lot_rules(spark), date="date").collect()}
    assert [lots[asked[i]] for i in (5, 6, 7, 8, 9)] == [50, 25, 75, 10, None]


def spine_of(spark, series):
    rows = []
    for symbol, spots in series.items():
        for i, s in enumerate(spots):
            day, slot = divmod(i, 11)
            when = dt.datetime(2024, 1, 1 + day, 9, 15) + dt.timedelta(minutes=5 * slot)
            rows.append((symbol, when.date(), when.strftime("%H:%M:%S"), float(s), when))
    return spark.createDataFrame(rows, "symbol string, date date, time string, spot double, ts timestamp_ntz")


def test_signals(spark):
    up = [48000 + 50 * i for i in range(40)]
    down = [48000 - 50 * i for i in range(40)]
    flat = [48000 + 10 * (i % 2) for i in range(40)]
    spine = spine_of(spark, {"up": up, "down": down, "flat": flat, "short": [1.0, 2.0]})

    def last(df):
        rows = {}
        for r in df.collect():
            if (r.symbol not in rows) or (r.date, r.time) > rows[r.symbol][0]:
                rows[r.symbol] = ((r.date, r.time), r.signal)
        return {k: v[1] for k, v in rows.items()}

    rsi = last(rsi_signal(spine, 14, 60.0, 40.0))
    assert (rsi["up"], rsi["down"], rsi["flat"], rsi["short"]) == ("bullish", "bearish", "neutral", "neutral")
    cross = last(ema_cross_signal(spine, 9, 21))
    assert (cross["up"], cross["down"]) == ("bullish", "bearish")
    trend = last(supertrend_signal(spine, 7, 3.0))
    assert (trend["up"], trend["down"], trend["short"]) == ("bullish", "bearish", "neutral")


def test_ema_equals_sequential(spark):
    import random

    rng = random.Random(5)
    spots = [1000 + rng.uniform(-20, 20) for _ in range(200)]
    got = {(r.date, r.time): r.ema for r in ema(spine_of(spark, {"x": spots}), 9).collect()}
    want, e = [], spots[0]
    for s in spots:
        e = s * 0.2 + e * 0.8 if want else s
        want.append(e)
    assert [got[k] for k in sorted(got)] == pytest.approx(want, abs=1e-9)


def test_range_breakout(spark):
    rows = [("u", "09:15:00", 48000.0), ("u", "09:30:00", 48050.0), ("u", "09:45:00", 48020.0), ("u", "10:00:00", 48100.0),
            ("d", "09:15:00", 48000.0), ("d", "09:45:00", 48020.0), ("d", "10:00:00", 47950.0), ("n", "10:00:00", 5.0)]
    df = spark.createDataFrame([(s, dt.date(2024, 1, 1), t, v) for s, t, v in rows], "symbol string, date date, time string, spot double")
    got = {(r.symbol, r.time): r.signal for r in range_breakout_signal(df, "09:45:00").collect()}
    assert [got[("u", t)] for t in ("09:15:00", "09:30:00", "09:45:00", "10:00:00")] == ["neutral"] * 3 + ["bullish"]
    assert got[("d", "10:00:00")] == "bearish" and got[("n", "10:00:00")] == "neutral"


def spline(x, y, at):
    """Tridiagonal sweep for a natural spline; flat outside."""
    if at <= x[0]:
        return y[0]
    if at >= x[-1]:
        return y[-1]
    n, h = len(x), [b - a for a, b in zip(x, x[1:])]
    m, cp, dp = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(1, n - 1):
        rhs = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        den = 2 * (h[i - 1] + h[i]) - h[i - 1] * cp[i - 1]
        cp[i], dp[i] = h[i] / den, (rhs - h[i - 1] * dp[i - 1]) / den
    for i in range(n - 2, 0, -1):
        m[i] = dp[i] - cp[i] * m[i + 1]
    i = max(k for k in range(n - 1) if x[k] <= at)
    a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6


def test_surface(spark):
    points = [(-5, 0.20), (0, 0.18), (5, 0.22), (10, 0.25)]
    day = dt.date(2024, 1, 1)
    rows = [("X", day, "09:15:00", o, "CE", v) for o, v in points] + [("X", day, "09:15:00", 7, "CE", 0.0), ("X", day, "09:20:00", 0, "CE", 0.2), ("X", day, "09:20:00", 5, "CE", 0.2)]
    bars = spark.createDataFrame(rows, "symbol string, date date, time string, strike_offset int, option_type string, iv double")
    ask = [("X", day, t, float(o)) for t in ("09:15:00", "09:20:00") for o in (-10, -5, -2, 0, 3, 5, 7.5, 10, 15)]
    got = iv_at(iv_surface(bars), spark.createDataFrame(ask, "symbol string, date date, time string, offset double")).collect()
    assert {r.time for r in got} == {"09:15:00"} and len(got) == 9
    xs, ys = [float(p[0]) for p in points], [p[1] for p in points]
    for r in got:
        assert r.iv == pytest.approx(spline(xs, ys, r.offset), abs=1e-12)


def test_rolls_and_ties(spark):
    rules = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), dt.date(2024, 12, 31), "monthly", "last_thursday"), ("A", dt.date(2024, 1, 1), dt.date(2024, 12, 31), "weekly", "Wednesday"),
         ("A", dt.date(2024, 2, 1), dt.date(2024, 12, 31), "weekly", "Friday")],
        "symbol string, from_date date, to_date date, type string, day string",
    )
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 26), dt.date(2024, 2, 1)]
    keys = spark.createDataFrame([("A", k, d) for d in days for k in ("weekly", "monthly", None)] + [("B", "weekly", days[0])], "symbol string, expiry_type string, date date")
    got = {(r.expiry_type, r.date): r.expiry_date for r in asof.roll_table(keys, rules).collect()}
    assert got == {
        ("weekly", days[0]): days[0], ("weekly", days[1]): dt.date(2024, 1, 31), ("weekly", days[2]): dt.date(2024, 2, 7),
        ("monthly", days[0]): dt.date(2024, 1, 25), ("monthly", days[1]): dt.date(2024, 2, 29), ("monthly", days[2]): dt.date(2024, 2, 29),
    }
    assert asof.with_expiry_dates(keys, rules).where("expiry_date IS NULL").count() == 4
    # Of rules that start together the weekly one gates.
    assert {r.expiry_type for r in asof.expiry_asof(keys.where("symbol = 'A'").select("symbol", "date"), rules).collect()} == {"weekly"}


def test_attribution_code_is_compiled(spark, capsys):
    """A generated method of more than 8,000 bytes is interpreted by the JVM, whatever the size of the data."""
    import re

    import __spark_entry__ as entry

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1")):
            spark.conf.set(k, v)
        for name in ("H04_pnl_attribution", "I05_greeks_totals", "I07_options_metrics", "I08_attribution_summary", "H01_H02_option_prices", "H03_greeks"):
            entry.queries()[name](spark, "/root/testdata/sf0.001").explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) <= 8000, (name, sizes)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

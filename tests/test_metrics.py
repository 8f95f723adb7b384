import datetime as dt

import pytest
from pyspark.sql import functions as F

from strikelake.plans import metrics as M

D0 = dt.date(2024, 1, 1)
SETS = {
    "basic": ([1000, -500, 800, -300, 600], ["time_exit"] * 5, [0] * 5),
    "factor": ([2400, -800], ["time_exit"] * 2, [0] * 2),
    "reasons": ([10, 10, -5, 5, 5], ["stop_loss", "combined_sl", "stop_loss", "target", "time_exit"], [0] * 5),
    "wins": ([100, 200], ["time_exit"] * 2, [0, 0]),
    "streak": ([1, 1, 1, -1, 1, 1, -1, 1, -1, -1, -1, 1], ["time_exit"] * 12, [0] * 12),
    "again": ([5, -5, 5], ["time_exit"] * 3, [1, 2, 3]),
    "ratio": ([1000, -500], ["time_exit"] * 2, [0] * 2),
    "year": ([100000], ["time_exit"], [0]),
}
CURVES = {"basic": [500000, 510000, 490000, 520000], "wins": [500000, 500100, 500300, 500400], "year": [500000, 600000]}


@pytest.fixture(scope="module")
def wide(spark):
    trades, daily, runs = [], [], []
    for name, (nets, reasons, again) in SETS.items():
        for i, (net, reason, a) in enumerate(zip(nets, reasons, again)):
            trades.append((name, D0 + dt.timedelta(days=i), i, float(net), float(net), 0.0, 0.0, 0.0, reason, i + 1, a))
        for i, e in enumerate(CURVES.get(name, [500000, 500000])):
            daily.append((name, D0 + dt.timedelta(days=i), float(e)))
        runs.append((name, 500000.0, D0, dt.date(2024, 12, 31)))
    runs.append(("idle", 500000.0, D0, D0))
    t = spark.createDataFrame(trades, "run_id string, exit_date date, seq int, pnl_gross double, pnl_net double, brokerage double, stt double, slippage_cost double, exit_reason string, bars_held int, reentry_attempt int")
    d = spark.createDataFrame(daily, "run_id string, date date, equity double")
    r = spark.createDataFrame(runs, "run_id string, capital double, start_date date, end_date date")
    return {x.run_id: x for x in M.run_metrics(t, d, r, ["seq"]).collect()}


def test_trade_figures(wide):
    b = wide["basic"]
    assert (b.total_trades, b.total_pnl_net, b.win_rate_pct, b.expectancy) == (5, 1600, 60, 320)
    assert wide["factor"].profit_factor == pytest.approx(3.0)
    r = wide["reasons"]
    assert (r.sl_hit_rate_pct, r.target_hit_rate_pct, r.time_exit_rate_pct) == (60, 20, 20)
    assert wide["ratio"].win_loss_ratio == pytest.approx(2.0)
    assert (wide["again"].reentry_count, wide["again"].reentry_win_rate) == (3, pytest.approx(66.6667, abs=1e-3))
    assert wide["wins"].profit_factor == float("inf") and wide["wins"].avg_loss == 0


def test_risk_figures(wide):
    b = wide["basic"]
    assert b.max_drawdown_inr == 20000 and b.max_drawdown_pct == pytest.approx(3.92, abs=0.01)
    assert b.cvar <= b.var_95
    w = wide["wins"]
    assert w.ulcer_index == 0 and w.omega_ratio > 1 and w.drawdown_duration_days == 0
    assert wide["year"].cagr == pytest.approx(0.20, abs=0.02)


def test_streaks(wide):
    assert (wide["streak"].max_consec_wins, wide["streak"].max_consec_losses) == (3, 3)


def test_idle_run_is_all_zero(wide):
    row = wide["idle"].asDict()
    assert all(v == 0 for k, v in row.items() if k != "run_id")


def test_drawdown_curve(spark):
    rows = [("r", D0 + dt.timedelta(days=i), dt.datetime(2024, 1, 1 + i), e) for i, e in enumerate([100000.0, 101500.0, 99800.0])]
    df = spark.createDataFrame(rows, "run_id string, date date, ts timestamp_ntz, equity double")
    got = [round(r.drawdown_pct, 2) for r in M.drawdown_curve(df, F.lit(100000.0)).orderBy("date").collect()]
    assert got == [0.0, 0.0, 1.67]

import datetime as dt
import random

import pytest

from strikelake.config import strategy_frames
from strikelake.plans.replay import replay
from strikelake.schemas import LEG_DEFAULTS, RUN_DEFAULTS

from . import fold

BAR = "symbol string, date date, time string, option_type string, strike_offset int, close double, high double, low double, spot double"


D = dt.date(2024, 1, 15)
BASE = dict(entry_time="09:20", exit_time="15:20", capital=500000.0, lot_size=15)
SLIP = dict(slippage_model="fixed_pts", slippage_value=1.0)
SELL = dict(option_type="CE", position="sell", stop_loss_enabled=True, stop_loss_type="percent_of_premium", stop_loss_value=100)
STRADDLE = [
    dict(option_type=k, position="sell", stop_loss_enabled=True, stop_loss_type="percent_of_premium", stop_loss_value=150)
    for k in ("CE", "PE")
]
OVERALL = dict(overall_sl_enabled=True, overall_sl_type="percent_of_premium", overall_sl_value=60.0,
               overall_target_enabled=True, overall_target_type="percent_of_premium", overall_target_value=50.0)
SL_TG = dict(option_type="CE", position="sell", stop_loss_enabled=True, stop_loss_type="points", stop_loss_value=50,
             target_profit_enabled=True, target_profit_type="points", target_profit_value=10)
AGAIN = dict(option_type="CE", position="sell", stop_loss_enabled=True, stop_loss_type="percent_of_premium", stop_loss_value=50,
             reentry_on_sl=True, reentry_mode="asap", reentry_max_attempts=2)
TGT = dict(option_type="CE", position="sell", target_profit_enabled=True, target_profit_type="percent_of_premium",
           target_profit_value=30, reentry_on_target=True, reentry_mode="asap", reentry_max_attempts=1)


def ce(*pairs, day=D):
    return [(day, f"{t}:00", "CE", 0, p) for t, p in pairs]


def both(ces, pes):
    rows = []
    for t, a, b in zip(("09:20:00", "12:00:00", "15:20:00"), ces, pes):
        rows += [(D, t, "CE", 0, a), (D, t, "PE", 0, b)]
    return rows


def three_days():
    rows = []
    for d in (15, 16, 17):
        rows += ce(("09:20", 200), ("12:00", 192.5), ("15:20", 185), day=dt.date(2024, 1, d))
    return rows


# name: (rows, legs, run fields, expected (reason, attempt) in order)
TIME = ce(("09:20", 200), ("12:00", 192.5), ("15:20", 185))
CASES = {
    "time_exit": (TIME, [SELL], SLIP, [("time_exit", 0)]),
    "stop": (ce(("09:20", 200), ("11:00", 420), ("15:20", 150)), [SELL], SLIP, [("stop_loss", 0)]),
    "wrong_time": (ce(("10:00", 200)), [SELL], SLIP, []),
    "after_last_bar": (ce(("09:15", 200)), [SELL], SLIP, []),
    "three_days": (three_days(), [SELL], SLIP, [("time_exit", 0)] * 3),
    "end_of_data": (ce(("09:20", 200), ("12:00", 190)), [SELL], SLIP, [("end_of_data", 0)]),
    "single_bar": (ce(("09:20", 200)), [SELL], SLIP, [("end_of_data", 0)]),
    "zero_price": (ce(("09:20", 0), ("15:20", 5)), [SELL], {}, [("time_exit", 0)]),
    "weekend": (ce(("09:20", 200), day=dt.date(2024, 1, 19)) + ce(("15:20", 180), day=dt.date(2024, 1, 22)), [SELL], {}, [("time_exit", 0)]),
    "straddle": (both((200, 190, 180), (180, 170, 160)), STRADDLE, OVERALL, [("time_exit", 0)] * 2),
    "combined_sl": (both((200, 350, 180), (180, 300, 160)), STRADDLE, OVERALL, [("combined_sl", 0)] * 2),
    "combined_target": (both((200, 90, 85), (180, 80, 75)), STRADDLE, OVERALL, [("combined_target", 0)] * 2),
    "stop_first": (ce(("09:20", 200), ("11:00", 280), ("15:20", 260)), [SL_TG], {}, [("stop_loss", 0)]),
    "again_asap": (ce(("09:20", 200), ("11:00", 310), ("13:00", 280), ("15:20", 250)), [AGAIN], {}, [("stop_loss", 0), ("time_exit", 1)]),
    "again_max": (
        ce(("09:20", 200), ("10:00", 310), ("11:00", 320), ("12:00", 490), ("13:00", 500), ("14:00", 800), ("15:00", 700), ("15:20", 600)),
        [AGAIN], {}, [("stop_loss", 0), ("stop_loss", 1), ("stop_loss", 2)],
    ),
    "again_after_bars": (
        ce(("09:20", 200), ("10:00", 310), ("10:30", 290), ("11:00", 280), ("11:30", 270), ("15:20", 250)),
        [{**AGAIN, "reentry_mode": "after_n_bars", "reentry_cooldown_bars": 2, "reentry_max_attempts": 1}], {},
        [("stop_loss", 0), ("time_exit", 1)],
    ),
    "again_target": (ce(("09:20", 200), ("11:00", 135), ("12:00", 120), ("15:20", 100)), [TGT], {}, [("target", 0), ("time_exit", 1)]),
    "no_again_on_time": (TIME, [AGAIN], SLIP, [("time_exit", 0)]),
    "again_momentum": (
        ce(("09:20", 200), ("10:00", 310), ("10:30", 290), ("11:00", 280), ("15:20", 250)),
        [{**AGAIN, "reentry_mode": "momentum_confirm", "momentum_filter_enabled": True}], {}, [("stop_loss", 0), ("time_exit", 1)],
    ),
}


@pytest.fixture(scope="module")
def replayed(spark):
    """All hand-made cases as runs of one replay, each with its own symbol."""
    confs, rows = [], []
    for name, (bars, legs, fields, _) in CASES.items():
        confs.append({**BASE, **fields, "run_id": name, "underlying": name, "legs": legs})
        rows += [(name, *r) for r in bars]
    runs, legs = strategy_frames(spark, confs)
    bars = spark.createDataFrame([(s, d, t, k, o, *[float(p)] * 3, 48000.0) for s, d, t, k, o, p in rows], BAR)
    signals = spark.createDataFrame([("again_momentum", D, "11:00:00", "bearish"), ("again_momentum", D, "10:30:00", "bullish")],
                                    "symbol string, date date, time string, signal string")
    res = replay(bars, runs, legs, signals)
    out = {}
    for r in res.trades.orderBy("exit_ts", "entry_ts", "leg_no").collect():
        out.setdefault(r.run_id, []).append(r)
    return out, {r.run_id: r["count"] for r in res.equity().groupBy("run_id").count().collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(replayed, name):
    got = [(r.exit_reason, r.reentry_attempt) for r in replayed[0].get(name, [])]
    assert got == CASES[name][3]


def test_details(replayed):
    trades, snapshots = replayed
    t = trades["time_exit"][0]
    assert t.pnl_gross > 0 and t.pnl_net < t.pnl_gross
    assert (t.entry_price, t.exit_price, t.brokerage) == (199, 186, 80)
    assert snapshots["time_exit"] == 3
    assert trades["stop"][0].pnl_gross < 0
    assert trades["again_after_bars"][1].entry_time == "11:00:00"
    assert trades["again_momentum"][1].entry_time == "11:00:00"
    assert trades["zero_price"][0].pnl_net is not None
    assert str(trades["weekend"][0].exit_date) == "2024-01-22"


def random_conf(rng, i):
    def leg():
        conf = dict(option_type=rng.choice(["CE", "PE"]), position=rng.choice(["buy", "sell"]), lots=rng.randint(1, 2),
                    strike_mode=rng.choice(["atm_offset", "atm_offset", "premium", "percent_otm"]), strike_offset=rng.randint(-1, 1),
                    premium_target=rng.choice([None, 90.0]))
        if rng.random() < 0.6:
            conf.update(stop_loss_enabled=True, stop_loss_type=rng.choice(["points", "percent_of_premium", "percent_of_margin", "index_points"]),
                        stop_loss_value=rng.choice([1.0, 10.0, 30.0]))
        if rng.random() < 0.5:
            conf.update(target_profit_enabled=True, target_profit_type=rng.choice(["points", "percent_of_premium"]), target_profit_value=rng.choice([15.0, 40.0]))
        if rng.random() < 0.4:
            conf.update(trail_sl_enabled=True, trail_sl_activate_at=rng.choice([5.0, 15.0]), trail_sl_mode=rng.choice(["lock", "trail"]),
                        trail_sl_lock_in=50.0, trail_sl_unit=rng.choice(["points", "percent"]), trail_sl_value=rng.choice([5.0, 30.0]))
        return conf

    legs = [leg() for _ in range(rng.randint(1, 3))]
    if rng.random() < 0.6:
        modes = rng.choice([["asap"], ["same_time"], ["after_n_bars"], ["asap", "after_n_bars", "momentum_confirm"], ["asap", "same_time", "after_n_bars", "momentum_confirm"]])
        for l in legs:
            if rng.random() < 0.8:
                l.update(reentry_on_sl=rng.random() < 0.8, reentry_on_target=rng.random() < 0.5, reentry_max_attempts=rng.randint(1, 3),
                         reentry_mode=rng.choice(modes), reentry_cooldown_bars=rng.randint(0, 4))
    conf = dict(run_id=f"r{i}", underlying=rng.choice(["A", "B"]), entry_time=rng.choice(["09:20", "10:20"]), exit_time=rng.choice(["12:20", "14:20", "23:00"]),
                capital=100000.0, lot_size=rng.choice([15, 25]), slippage_model=rng.choice(["none", "fixed_pts", "percent"]), slippage_value=1.0, legs=legs)
    if rng.random() < 0.5:
        conf.update(overall_sl_enabled=True, overall_sl_type=rng.choice(["percent_of_premium", "points", "combined_premium"]), overall_sl_value=rng.choice([20.0, 400.0]))
    if rng.random() < 0.4:
        conf.update(overall_target_enabled=True, overall_target_type=rng.choice(["percent_of_premium", "points"]), overall_target_value=rng.choice([15.0, 300.0]))
    return conf


def random_bars(rng, symbol):
    out, spot = [], 1000.0
    for d in range(12):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        times = [f"{h:02d}:20:00" for h in range(9, 15)]
        if rng.random() < 0.25:
            times = times[: rng.randint(1, 4)]
        for t in times:
            spot += rng.choice([-12, -4, 0, 5, 11])
            for kind in ("CE", "PE"):
                for off in (-1, 0, 1):
                    if rng.random() < 0.75:
                        close = float(rng.randint(60, 140))
                        out.append(dict(symbol=symbol, date=day, time=t, option_type=kind, strike_offset=off, close=close,
                                        high=close + rng.randint(0, 25), low=close - rng.randint(0, 25), spot=float(spot)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_fold(spark, seed):
    rng = random.Random(seed)
    data = {s: random_bars(rng, s) for s in ("A", "B")}
    confs = [random_conf(rng, i) for i in range(60)]
    runs, legs = strategy_frames(spark, confs)
    rows = data["A"] + data["B"]
    bars = spark.createDataFrame([tuple(r[k.split()[0]] for k in BAR.split(", ")) for r in rows], BAR)
    words = {s: {k: rng.choice(["bullish", "bearish", "neutral"]) for k in sorted({(r["date"], r["time"]) for r in data[s]})} for s in data}
    flat = [(s, d, t, w) for s, mine in words.items() for (d, t), w in mine.items()]
    signals = spark.createDataFrame(flat, "symbol string, date date, time string, signal string")
    res = replay(bars, runs, legs, signals)
    got, equity, daily = {}, {}, {}
    for r in res.trades.collect():
        got.setdefault(r.run_id, []).append(
            ((r.entry_date, r.entry_time), (r.exit_date, r.exit_time), r.leg_no, r.exit_reason, r.bars_held, r.reentry_attempt, r.held_offset,
             round(r.entry_price, 6), round(r.exit_price, 6), round(r.pnl_gross, 5), round(r.pnl_net, 5))
        )
    for r in res.equity().collect():
        equity.setdefault(r.run_id, {})[(r.date, r.time)] = r.equity
    for r in res.daily_equity().collect():
        daily[(r.run_id, r.date)] = r.equity
    n = 0
    for conf in confs:
        run_row = {**RUN_DEFAULTS, **{k: v for k, v in conf.items() if k != "legs"}}
        run_row["entry_time"] += ":00"
        run_row["exit_time"] += ":00"
        want, snaps = fold.replay(run_row, [{**LEG_DEFAULTS, **l} for l in conf["legs"]], data[conf["underlying"]], words[conf["underlying"]])
        want = sorted(
            (t["entry"], t["exit"], t["leg_no"], t["reason"], t["bars_held"], t["attempt"], t["offset"],
             round(t["entry_price"], 6), round(t["exit_price"], 6), round(t["gross"], 5), round(t["net"], 5)) for t in want
        )
        n += len(want)
        assert sorted(got.get(conf["run_id"], [])) == want, conf
        assert set(equity[conf["run_id"]]) == {k for k, _ in snaps}
        for k, v in snaps:
            assert equity[conf["run_id"]][k] == pytest.approx(v, abs=1e-6), (conf, k)
        for day, v in {k[0]: v for k, v in snaps}.items():
            assert daily[(conf["run_id"], day)] == pytest.approx(v, abs=1e-6)
    assert n > 300


def test_a_pass_reads_only_the_days_its_positions_may_be_held(spark, monkeypatch):
    from strikelake.plans import replay as plan

    rows = ce(("09:20", 200), ("11:00", 320), ("12:00", 200), ("15:20", 190))
    for d in (16, 17, 18):
        rows += ce(("09:20", 200), ("12:00", 195), ("15:20", 190), day=dt.date(2024, 1, d))
    bars = spark.createDataFrame([("X", *r[:4], *[float(r[4])] * 3, 100.0) for r in rows], BAR)
    runs, legs = strategy_frames(spark, [{"run_id": "again", "underlying": "X", **BASE, "legs": [AGAIN]}])
    days = []
    plain = plan._evaluate
    monkeypatch.setattr(plan, "_evaluate", lambda *a: days.append(a[3].select("date").distinct().count()) or plain(*a))
    got = replay(bars, runs, legs).trades.orderBy("entry_ts").collect()
    assert [(r.exit_reason, r.reentry_attempt) for r in got] == [("stop_loss", 0), ("time_exit", 1)] + [("time_exit", 0)] * 3
    assert days == [4, 1]

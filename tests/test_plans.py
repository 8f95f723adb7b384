import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.config import strategy_frames
from strikelake.plans import portfolio as PF
from strikelake.plans import resample as RS
from strikelake.plans import sweep as SW
from strikelake.plans import validate as V
from strikelake.plans import walkforward as WF
from strikelake.sources import bars as B
from strikelake.sources import results as R


def plain_shuffles(rows, capital, sims, seed, block, chunk):
    """Equity paths of all simulations of one run's (number, pnl) rows, by the rule in plain words."""
    prime = 2**31 - 1

    def key(x, *names):
        text = hashlib.md5("|".join(map(str, names)).encode()).hexdigest()
        value = 0
        for i in range(0, 32, 8):
            value = (value * x + int(text[i : i + 8], 16)) % prime
        return value

    marked = []
    for number, pnl in rows:
        mark = hashlib.md5(str(number).encode()).hexdigest()
        marked.append((mark, int(mark[:8], 16) % prime, pnl))
    n_blocks, out = -(-len(rows) // block), []
    for sim in range(sims):
        def place(m):
            mine = key(m[1], seed, "deal", sim // chunk) * n_blocks // prime if n_blocks > 1 else 0
            return key(mine + 1, seed, sim), mine, key(m[1], seed, sim), m[0]

        out.append(list(np.cumsum([m[2] for m in sorted(marked, key=place)]) + capital))
    return out


@pytest.mark.parametrize("block, chunk, sims", [(1 << 16, 25, 60), (16, 7, 20)])
def test_shuffles_against_plain_rule(spark, block, chunk, sims):
    rng = random.Random(block)
    runs = {"r": [(i, float(rng.randint(-300, 310))) for i in range(100)], "one": [(5, -40.0)]}
    t = spark.createDataFrame([(r, i, x) for r, some in runs.items() for i, x in some], "run_id string, no int, pnl_net double")
    capital, seed = 2000.0, 12345
    paths = {r: plain_shuffles(some, capital, sims, seed, block, chunk) for r, some in runs.items()}
    assert len({tuple(p) for p in paths["r"]}) == sims

    def rank(values, p):
        return sorted(values)[int(p / 100 * (sims - 1) + 0.5)]

    args = (F.lit(capital), sims, seed, ["no"])
    bands = {(r.run_id, r.trade_index): tuple(r)[2:] for r in RS.shuffle_bands(t, *args, block=block, chunk=chunk).collect()}
    assert bands == {(r, i): tuple(rank([p[i] for p in some], q) for q in (5, 25, 50, 75, 95)) for r, some in paths.items() for i in range(len(some[0]))}
    table = spark.createDataFrame([("r", capital), ("one", capital), ("empty", 7.0)], "run_id string, capital double")
    got = {r.run_id: r for r in RS.shuffle_summary(t, table, *args, block=block, chunk=chunk).collect()}
    drops = []
    for p in paths["r"]:
        peaks = np.maximum.accumulate([capital, *p])[1:]
        drops.append(max((peaks - p) / peaks * 100))
    assert got["r"].mdd_p50 == pytest.approx(rank(drops, 50)) and got["r"].mdd_p95 == pytest.approx(rank(drops, 95))
    assert got["r"].final_p5 == got["r"].final_p95 == paths["r"][0][-1] and (got["r"].n_trades, got["r"].n_simulations) == (100, sims)
    assert got["r"].prob_mdd_gt_20pct == sum(d > 20 for d in drops) / sims
    assert got["one"].final_p50 == 1960.0 and got["one"].mdd_p95 == pytest.approx(2.0)
    assert got["empty"].final_p50 == 7.0 and got["empty"].mdd_p95 == 0 and got["empty"].n_trades == 0


def test_bootstrap(spark):
    rows = [("r", dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i == 0 else 0.01) for i in range(6)]
    s = spark.createDataFrame(rows, "run_id string, date date, daily_return double")
    got = {r.step: r for r in RS.bootstrap_bands(s, F.lit(100.0), 20, 1).collect()}
    assert sorted(got) == list(range(6)) and got[0].p50 == 100.0
    assert got[5].p5 == pytest.approx(100 * 1.01**5) and got[5].p95 == pytest.approx(100 * 1.01**5)


def test_walk_forward_windows(spark):
    span = spark.createDataFrame([("r", dt.date(2020, 1, 31), dt.date(2023, 12, 30)), ("short", dt.date(2020, 1, 1), dt.date(2020, 3, 1))], "run_id string, start_date date, end_date date")
    w = WF.wf_windows(span).orderBy("window_id").collect()
    assert {r.run_id for r in w} == {"r"} and 10 <= len(w) <= 25
    assert all(r.is_end == r.oos_start and r.oos_end <= dt.date(2023, 12, 30) for r in w)
    assert w[0].is_start == dt.date(2020, 1, 31) and w[0].is_end == dt.date(2020, 7, 28) and w[1].is_start == dt.date(2020, 3, 28)


def test_grid(spark):
    one = SW.param_grid(spark, [{"name": "sl_value", "min": 20, "max": 50, "step": 10}]).collect()
    assert [r.params["sl_value"] for r in one] == [20.0, 30.0, 40.0, 50.0]
    two = SW.param_grid(spark, [{"name": "a", "min": 1, "max": 2, "step": 1}, {"name": "b", "min": 0, "max": 0.2, "step": 0.1}]).orderBy("combo_index").collect()
    assert [(r.params["a"], r.params["b"]) for r in two] == [(1, 0), (1, 0.1), (1, 0.2), (2, 0), (2, 0.1), (2, 0.2)]
    assert [r.params for r in SW.param_grid(spark, []).collect()] == [{}]
    assert spark.range(1).select(SW.range_values(5, 1, 1)).first()[0] == [5.0]


def test_overrides(spark):
    conf = dict(run_id="r", underlying="X", entry_time="09:20", exit_time="15:20", capital=1.0,
                legs=[dict(option_type="CE", position="sell", lots=3, stop_loss_value=9.0)])
    runs, legs = strategy_frames(spark, [conf])
    r, l = SW.apply_overrides(runs, legs, [{"name": "lots", "min": 0, "max": 0, "step": 1}, {"name": "target_value", "min": 7, "max": 7, "step": 0}, {"name": "other", "min": 1, "max": 1, "step": 1}])
    assert r.first().overall_target_enabled and r.first().overall_target_value == 7.0
    assert (l.first().lots, l.first().stop_loss_value, l.first().strike_offset) == (1, 9.0, 0)


def test_unknown_fields_are_refused(spark):
    with pytest.raises(ValueError, match="unknown"):
        strategy_frames(spark, [dict(run_id="r", underlying="X", entry_time="09:20", exit_time="15:20", capital=1.0, legs=[], momentum_type="rsi")])
    with pytest.raises(ValueError, match="strike_mode"):
        strategy_frames(spark, [dict(run_id="r", underlying="X", entry_time="09:20", exit_time="15:20", capital=1.0, legs=[dict(option_type="CE", position="sell", strike_mode="far")])])


def test_combined_equity_carries_forward(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), 110.0), ("a", d(2024, 1, 3), 120.0), ("b", d(2024, 1, 2), 45.0)]
    daily = spark.createDataFrame(rows, "run_id string, date date, equity double")
    al = spark.createDataFrame([("p", "a", 60.0, 100.0), ("p", "b", 40.0, 50.0)], "portfolio string, run_id string, allocation_pct double, allocated_capital double")
    assert [r.equity for r in PF.combined_equity(daily, al).orderBy("date").collect()] == [160.0, 155.0, 165.0]


def test_correlation(spark):
    rows, ids = [], {"up": [1, 2, 3, 4, 5], "twice": [2, 4, 6, 8, 10], "down": [5, 4, 3, 2, 1], "still": [1, 1, 1, 1, 1]}
    for name, pnls in ids.items():
        e = 100.0
        rows.append((name, dt.date(2024, 1, 1), e))
        for i, p in enumerate(pnls):
            e += p
            rows.append((name, dt.date(2024, 1, 2 + i), e))
    daily = spark.createDataFrame(rows, "run_id string, date date, equity double")
    al = spark.createDataFrame([("p", n) for n in ids], "portfolio string, run_id string")
    m = {(r.strategy_a, r.strategy_b): r.correlation for r in PF.correlation_matrix(daily, al).collect()}
    assert len(m) == 16 and all(m[(n, n)] == 1 for n in ids)
    assert m[("up", "twice")] == pytest.approx(1) and m[("up", "down")] == pytest.approx(-1) and m[("up", "still")] == 0
    assert all(m[(a, b)] == m[(b, a)] for a, b in m)


def test_margin_admission_against_loop(spark):
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    pos = []
    for p, cap in (("tight", 100.0), ("wide", 10000.0)):
        for i in range(150):
            start = base + dt.timedelta(minutes=rng.randint(0, 3000))
            pos.append((p, f"s{i:03d}", start, start + dt.timedelta(minutes=rng.choice([0, 5, 40])), float(rng.randint(10, 60))))
    df = spark.createDataFrame(pos, "portfolio string, run_id string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, margin double")
    caps = spark.createDataFrame([("tight", 100.0), ("wide", 10000.0)], "portfolio string, total_capital double")
    got = {(r.portfolio, r.run_id): r.accepted for r in PF.margin_admission(df, caps).collect()}
    assert len(got) == len(pos)
    refused = 0
    for p, cap in (("tight", 100.0), ("wide", 10000.0)):
        held = []
        for _, run, a, b, m in sorted((x for x in pos if x[0] == p), key=lambda x: (x[2], x[1])):
            held = [h for h in held if h[0] > a]
            ok = m <= cap - sum(h[1] for h in held)
            if ok:
                held.append((b, m))
            refused += not ok
            assert got[(p, run)] == ok
    assert refused > 5


def test_margin_fixture(spark):
    t = dt.datetime(2024, 1, 1, 9, 20)
    rows = [("p", "a", t, t + dt.timedelta(hours=2), 80000.0), ("p", "b", t + dt.timedelta(hours=1), t + dt.timedelta(hours=3), 50000.0)]
    df = spark.createDataFrame(rows, "portfolio string, run_id string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, margin double")
    caps = spark.createDataFrame([("p", 100000.0)], "portfolio string, total_capital double")
    got = {r.run_id: (r.accepted, r.available_margin) for r in PF.margin_admission(df, caps).collect()}
    assert got == {"a": (True, 100000.0), "b": (False, 20000.0)}
    wide = caps.withColumn("total_capital", F.lit(200000.0))
    got = {r.run_id: (r.accepted, r.available_margin) for r in PF.margin_admission(df, wide).collect()}
    assert got == {"a": (True, 200000.0), "b": (True, 120000.0)}
    assert PF.peak_margin(PF.margin_timeline(df)).first().peak_margin_used == 130000.0


BAR = ["2024-01-31", "09:15", "CE", "1", "10.5", "12", "9", "11"]


def test_bars_round_trip(spark, tmp_path):
    head = ",".join(f.name for f in B.S.BARS.fields)
    lines = [head]
    for day, off, vol, iv in (("2024-01-31", 0, "10", "0.2"), ("2024-02-01", 1, "12.0", "bad"), ("nope", 0, "1", "0.1")):
        lines.append(f"{day} 09:15:00+05:30,{day},09:15:00,Monday,CE,ATM,{off},ATM,1,2,0.5,1.5,{vol},48000,5,48000,{iv}")
    src = tmp_path / "x.csv"
    src.write_text("\n".join(lines))
    got = B.ingest_csv(spark, str(src), "banknifty")
    assert got.count() == 2
    base = str(tmp_path / "bars")
    B.write_bars(got, base)
    feb = B.scan_bars(spark, base, ["BANKNIFTY", "banknifty"], ["weekly"], dt.date(2024, 2, 1), dt.date(2024, 2, 28))
    row = feb.first()
    assert feb.count() == 1 and row.volume == 0 and row.iv == 0 and str(row.date) == "2024-02-01"
    assert sorted((r.year, r.month) for r in B.list_available(spark, base).collect()) == [(2024, 1), (2024, 2)]
    assert B.storage_total(B.file_inventory(spark, base)).first().files == 2
    assert B.scan_bars(spark, str(tmp_path / "absent")).count() == 0
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan


def test_result_tables_round_trip(spark, tmp_path):
    base = str(tmp_path)
    e = spark.createDataFrame([("r", dt.date(2024, 1, 1 + i), v) for i, v in enumerate([100000.0, 101500.0, 99800.0])], "run_id string, date date, equity double")
    m = spark.createDataFrame([("r", 1.5, float("inf"))], "run_id string, sharpe_ratio double, profit_factor double")
    t = spark.createDataFrame([("r", 2, 5.0, "time_exit", 1), ("r", 1, float("nan"), "target", 2)], "run_id string, seq int, pnl_net double, exit_reason string, lots int")
    R.write_results(t, e, m, base, ["seq"])
    back = R.read_results(spark, base, "trades", "r").orderBy("trade_id").collect()
    assert [(r.trade_id, r.pnl_net, r.lots) for r in back] == [(0, None, 2), (1, 5.0, 1)]
    dd = [round(r.drawdown_pct, 2) for r in R.read_results(spark, base, "equity_curves", "r").orderBy("date").collect()]
    assert dd == [0.0, 0.0, 1.67]
    assert R.metrics_map(R.read_results(spark, base, "metrics", "r")).first().metrics == {"sharpe_ratio": 1.5, "profit_factor": None}


def test_portfolio_rules(spark):
    p = spark.createDataFrame([("ok", 500000.0), ("sum", 1.0), ("none", 1.0), ("neg", -1.0)], "portfolio string, total_capital double")
    a = spark.createDataFrame([("ok", "x", 60.0), ("ok", "y", 40.2), ("sum", "x", 50.0), ("neg", "x", 100.0)], "portfolio string, name string, allocation_pct double")
    assert {(r.portfolio, r.rule) for r in V.validate_portfolio(p, a).collect()} == {("sum", "allocations_not_100"), ("none", "no_strategies"), ("neg", "capital_not_positive")}
    got = {r.name: r.allocated_capital for r in V.allocated_capital(p, a).where("portfolio = 'ok'").collect()}
    assert got["x"] == 300000


def test_queries_and_texts_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_sweep_adds_no_frames(spark):
    """Stops, targets and lots share the bars of a held contract; another strike holds other bars."""
    from strikelake.operators.contracts import bar_spine, entry_candidates, horizons
    from strikelake.plans import hits, replay, sweep

    rows = [
        ("A", dt.date(2024, 1, d), f"{h:02d}:20:00", kind, off, 100.0 + 7 * off + h * d % 13, 130.0, 60.0, 1000.0)
        for d in range(1, 6) for h in range(9, 15) for kind in ("CE", "PE") for off in (-1, 0, 1)
    ]
    bars = spark.createDataFrame(rows, "symbol string, date date, time string, option_type string, strike_offset int, close double, high double, low double, spot double")
    leg = dict(option_type="CE", position="sell", stop_loss_enabled=True, stop_loss_type="points", stop_loss_value=5)
    runs, legs = strategy_frames(spark, [dict(run_id="r", underlying="A", entry_time="09:20", exit_time="14:20", capital=1e5, lot_size=15, legs=[leg, {**leg, "option_type": "PE"}])])

    def frames(ranges):
        many, many_legs = sweep.apply_overrides(runs, legs, ranges)
        spine = bar_spine(bars)
        opened = replay.with_horizon(replay.open_legs(entry_candidates(spine, many), many.drop("base_run_id", "combo_index", "params"), many_legs, bars), horizons(spine, many))
        positions = hits.positions_of(opened)
        return positions.count(), hits.index_frames(positions, lambda held, by: replay.held_bars(held, bars, by), "offset").count()

    stops = {"name": "sl_value", "min": 1, "max": 30, "step": 1}
    assert frames([stops, {"name": "lots", "min": 1, "max": 3, "step": 1}]) == (5 * 90, 5)
    assert frames([stops, {"name": "strike_offset", "min": -1, "max": 1, "step": 1}]) == (5 * 90, 15)


def test_bands_of_a_held_run_are_ranked_in_its_tasks(spark):
    t = spark.createDataFrame([("r", i, float(i % 7 - 3)) for i in range(100)] + [("s", i, 1.0 - i % 3) for i in range(40)], "run_id string, no int, pnl_net double")
    args = (F.lit(50.0), 20, 3, ["no"])
    bands = RS.shuffle_bands(t, *args, block=16, chunk=7)
    plan = bands._jdf.queryExecution().optimizedPlan().toString()
    assert "values" not in plan and "slice" not in plan
    want = sorted(map(tuple, bands.collect()))
    assert len(want) == 140
    for held in (10, 50):
        assert sorted(map(tuple, RS.shuffle_bands(t, *args, block=16, chunk=7, held=held).collect())) == want


def test_summary_of_a_held_run_sends_its_trades_to_few_tasks(spark, monkeypatch):
    t = spark.createDataFrame([("r", i, float(i % 7 - 3)) for i in range(100)] + [("s", i, 1.0 - i % 3) for i in range(40)], "run_id string, no int, pnl_net double")
    runs = spark.createDataFrame([("r", 50.0), ("s", 50.0), ("none", 5.0)], "run_id string, capital double")
    args = (F.lit(50.0), 20, 3, ["no"])
    sent, deal = [], RS._by_size
    monkeypatch.setattr(RS, "_by_size", lambda *a: sent.append(deal(*a)) or sent[-1])
    want = sorted(map(tuple, RS.shuffle_summary(t, runs, *args, block=16, chunk=2).collect()))
    shared, larger = sent[0]
    tasks = RS.TASKS * spark.sparkContext.defaultParallelism
    assert larger is None and shared.count() < 140 * 10
    assert shared.select("run_id", "part").distinct().count() <= tasks + 2
    assert [r[-2:] for r in want] == [(0, 0), (20, 100), (20, 40)]
    for held in (10, 50):
        assert sorted(map(tuple, RS.shuffle_summary(t, runs, *args, block=16, chunk=2, held=held).collect())) == want


def test_positions_of_a_sweep_are_not_broadcast(spark, monkeypatch):
    from strikelake.plans import replay

    start = dt.datetime(2024, 1, 1, 9)
    rows = [("X", t.date(), t.time().isoformat(), "CE", 0, 100.0 + i % 7, 110.0, 90.0, 100.0, 1000.0, 1000.0) for i in range(40) for t in [start + dt.timedelta(hours=5 * i)]]
    bars = spark.createDataFrame(rows, "symbol string, date date, time string, option_type string, strike_offset int, close double, high double, low double, open double, spot double, strike double")
    base = [{"run_id": "a", "underlying": "X", "entry_time": "09:00:00", "exit_time": "19:00:00", "capital": 1e5, "lot_size": 15, "legs": [{"option_type": "CE", "position": "sell", "stop_loss_enabled": True, "stop_loss_type": "points"}]}]
    plans, cut = [], replay.cut_lineage
    for module in (replay, SW):
        monkeypatch.setattr(module, "cut_lineage", lambda df: plans.append((df.columns, df._jdf.queryExecution().sparkPlan().toString())) or cut(df))
    runs, legs = strategy_frames(spark, base)
    assert SW.sweep_metrics(bars, runs, legs, [{"name": "sl_value", "min": 1, "max": 9, "step": 1}]).count() == 9
    big = {("frame", "bars"): 1, ("reason", "start_ts"): 1, ("pnl_net", "exit_reason"): 2}
    for names, joins in big.items():
        (plan,) = [text for columns, text in plans if set(names) <= set(columns)]
        assert plan.count("SortMergeJoin") == joins and "Broadcast" not in plan, names


def test_shuffled_blocks_stay_rows_until_a_task_reads_one(spark):
    t = spark.createDataFrame([("r", i, float(i)) for i in range(40)], "run_id string, no int, pnl_net double")
    dealt = RS._dealt(t, F.lit(1.0), 20, 1, ["no"], ["run_id"], 16, 10)
    assert "collect_list" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    blocks = dealt.groupBy("chunk", "block").count().collect()
    assert len(blocks) == 6 and sum(r["count"] for r in blocks) == 2 * 40


def test_tables_of_a_sweep_are_not_broadcast(spark):
    base = [{"run_id": "a", "underlying": "X", "entry_time": "09:20", "exit_time": "15:20", "capital": 1e5, "lot_size": 15, "legs": [{"option_type": "CE", "position": "sell"}]}]
    runs, legs = SW.apply_overrides(*strategy_frames(spark, base), [{"name": "sl_value", "min": 1, "max": 9, "step": 1}])
    small = spark.createDataFrame([("a#1", 0)], "run_id string, leg_no int")
    for big in (runs.drop("params"), legs):
        assert "Broadcast" not in small.join(big, "run_id")._jdf.queryExecution().executedPlan().toString()

"""Registered queries: contract choice, exits, trades and equity of strategies on the derived bars.

The DuckDB text states the rules bar by bar on a dense grid of every bar time of every
position, so it shares no intermediate with the Spark plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import per_symbol
from ..operators.contracts import bar_spine, entry_candidates, horizons, select_contract, with_ordinals
from ..plans import replay as R
from ..session import cut_lineage
from ..schemas import LEG_DEFAULTS, LEGS, RUN_DEFAULTS, RUNS
from .inputs import BARS_SQL, bars, text_dates

SELL, BUY = "sell", "buy"


def leg(kind="CE", position=SELL, **kw):
    return {"option_type": kind, "position": position, **kw}


def strategy(name, legs, **kw):
    base = {"run_id": name, "underlying": "", "entry_time": "09:00:00", "exit_time": "15:00:00", "capital": 500000.0, "lot_size": 15}
    return {**base, **kw, "legs": legs}


def sl(kind, value):
    return {"stop_loss_enabled": True, "stop_loss_type": kind, "stop_loss_value": float(value)}


def target(kind, value):
    return {"target_profit_enabled": True, "target_profit_type": kind, "target_profit_value": float(value)}


def trail(mode, activate, **kw):
    return {"trail_sl_enabled": True, "trail_sl_mode": mode, "trail_sl_activate_at": float(activate), **kw}


SELECTION = [
    strategy("atm", [leg("CE"), leg("PE", BUY)]),
    strategy("otm1", [leg("CE", strike_offset=1), leg("PE", strike_offset=-1)], entry_time="10:00:00"),
    strategy("premium", [leg("CE", strike_mode="premium", premium_target=40.0), leg("PE", strike_mode="premium")], entry_time="11:00:00"),
    strategy("percent_otm", [leg("CE", strike_mode="percent_otm", strike_offset=1), leg("PE", strike_mode="percent_otm", strike_offset=-2)]),
]
LEG_STOPS = [
    strategy("points", [leg("CE", **sl("points", 5))]),
    strategy("premium", [leg("PE", BUY, **sl("percent_of_premium", 40))]),
    strategy("margin", [leg("CE", **sl("percent_of_margin", 0.5))]),
    strategy("index", [leg("CE", **sl("index_points", 300)), leg("PE", BUY, **sl("index_points", 500))]),
    strategy("combined", [leg("CE", **sl("combined_premium", 1))]),
    strategy("both", [leg("CE", **sl("points", 20), **target("points", 10)), leg("PE", **target("percent_of_premium", 30))]),
]
TARGETS = [
    strategy("points", [leg("CE", **target("points", 10))]),
    strategy("premium", [leg("PE", BUY, **target("percent_of_premium", 25)), leg("CE")]),
]
TRAILING = [
    strategy("lock", [leg("CE", strike_mode="percent_otm", **trail("lock", 20, trail_sl_lock_in=50.0))]),
    strategy("percent", [leg("PE", strike_mode="percent_otm", **trail("trail", 10, trail_sl_unit="percent", trail_sl_value=30.0))]),
    strategy("points", [leg("CE", BUY, strike_mode="percent_otm", **trail("trail", 10, trail_sl_unit="points", trail_sl_value=5.0), **sl("percent_of_premium", 90))]),
]
_PAIR = [leg("CE", strike_mode="percent_otm"), leg("PE", strike_mode="percent_otm")]
OVERALL = [
    strategy("sl_pct", _PAIR, overall={"overall_sl_enabled": True, "overall_sl_type": "percent_of_premium", "overall_sl_value": 30.0}),
    strategy("sl_points", _PAIR, overall={"overall_sl_enabled": True, "overall_sl_type": "points", "overall_sl_value": 400.0}),
    strategy("sl_combined", _PAIR, overall={"overall_sl_enabled": True, "overall_sl_type": "combined_premium", "overall_sl_value": 700.0}),
    strategy("tg_pct", _PAIR, overall={"overall_target_enabled": True, "overall_target_type": "percent_of_premium", "overall_target_value": 20.0}),
    strategy("tg_points", _PAIR, overall={"overall_target_enabled": True, "overall_target_type": "points", "overall_target_value": 500.0}),
]
COSTS = [
    strategy("none", _PAIR),
    strategy("fixed", _PAIR, slippage_model="fixed_pts", slippage_value=1.5, brokerage_per_lot=20.0),
    strategy("percent", [leg("CE", BUY, lots=2, **sl("points", 10)), leg("PE", **target("points", 5))], slippage_model="percent", slippage_value=2.0, stt_on_sell=False),
]
CARRIED = [
    strategy("until_stop", [leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 400))], exit_time="23:30:00"),
    strategy("until_end", [leg("PE", BUY, strike_mode="percent_otm")], exit_time="23:30:00"),
    strategy("until_target", [leg("PE", strike_mode="percent_otm", **target("percent_of_premium", 80))], entry_time="13:00:00", exit_time="23:30:00"),
]
REENTRY = [
    strategy("asap", [leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 30), reentry_on_sl=True, reentry_mode="asap", reentry_max_attempts=3)]),
    strategy("same_time", [leg("CE", strike_mode="percent_otm", **target("percent_of_premium", 30), reentry_on_target=True, reentry_mode="same_time", reentry_max_attempts=2)]),
    strategy("after_n", [leg("PE", strike_mode="percent_otm", **sl("points", 20), reentry_on_sl=True, reentry_mode="after_n_bars", reentry_cooldown_bars=2, reentry_max_attempts=2)]),
    strategy("momentum", [leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 30), reentry_on_sl=True, reentry_mode="momentum_confirm", reentry_max_attempts=3)]),
    strategy("mixed", [
        leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 30), reentry_on_sl=True, reentry_mode="asap", reentry_max_attempts=2),
        leg("PE", BUY, strike_mode="percent_otm", **target("percent_of_premium", 60), reentry_on_sl=True, reentry_on_target=True,
            reentry_mode="after_n_bars", reentry_cooldown_bars=30, reentry_max_attempts=3),
        leg("PE", BUY, **sl("percent_of_premium", 70), reentry_on_sl=True, reentry_mode="momentum_confirm", reentry_max_attempts=4),
    ]),
    strategy("mixed_time", [
        leg("CE", **sl("percent_of_premium", 30), reentry_on_sl=True, reentry_mode="after_n_bars", reentry_cooldown_bars=3, reentry_max_attempts=2),
        leg("PE", strike_mode="percent_otm", **target("percent_of_premium", 20), reentry_on_target=True, reentry_mode="same_time", reentry_max_attempts=1),
    ], exit_time="23:30:00"),
]


def frames(spark, sf, configs):
    b = cut_lineage(bars(spark, sf))
    runs, legs = per_symbol(configs, cut_lineage(b.select("symbol").distinct()))
    return b, runs, legs


# ------------------------------------------------------------------ DuckDB side


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v + "'"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def _values(name, schema, rows):
    cols = [f.name for f in schema.fields]
    body = ",\n".join("(" + ", ".join(_lit(r[k]) for k in cols) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


def config_sql(configs):
    runs, legs = [], []
    for conf in configs:
        flat = {k: v for k, v in conf.items() if k not in ("legs", "overall", "underlying")}
        runs.append({**RUN_DEFAULTS, **flat, **conf.get("overall", {}), "symbol": ""})
        for no, one in enumerate(conf["legs"]):
            legs.append({**LEG_DEFAULTS, **one, "run_id": conf["run_id"], "leg_no": no})
    return f"""{_values('runs0', RUNS, runs)}, {_values('legs', LEGS, legs)},
symbols AS (SELECT DISTINCT symbol FROM bars),
runs AS (SELECT r.* EXCLUDE (symbol), s.symbol FROM runs0 r, symbols s)"""


PLAIN_B = "b AS (SELECT *, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS delta FROM bars)"

OPEN_SQL = """
spine AS (SELECT symbol, date, time, ts, min_by(spot, (strike_offset, option_type)) AS spot FROM b GROUP BY ALL),
picked AS (
  SELECT r.run_id, r.symbol, sp.ts AS entry_ts, l.leg_no, l.option_type, b.strike_offset AS held_offset, b.close AS raw_price, b.spot AS entry_spot,
    row_number() OVER (PARTITION BY r.run_id, r.symbol, sp.ts, l.leg_no ORDER BY
      CASE l.strike_mode WHEN 'premium' THEN abs(b.close - coalesce(l.premium_target, 200.0))
                         WHEN 'percent_otm' THEN abs(b.strike_offset - l.strike_offset)
                         WHEN 'delta' THEN CASE WHEN b.delta <> 0 THEN abs(abs(b.delta) - l.delta_target) WHEN b.strike_offset = 0 THEN 1e6 ELSE 2e6 END
                         ELSE 0 END, b.strike_offset) AS rk
  FROM runs r JOIN spine sp ON sp.symbol = r.symbol AND sp.time = r.entry_time JOIN legs l ON l.run_id = r.run_id
  JOIN b ON b.symbol = sp.symbol AND b.ts = sp.ts AND b.option_type = l.option_type
    AND (l.strike_mode <> 'atm_offset' OR b.strike_offset = l.strike_offset)),
opened AS (
  SELECT p.* EXCLUDE (rk), r.* EXCLUDE (run_id, symbol), l.* EXCLUDE (run_id, leg_no, option_type, strike_offset),
    CASE WHEN l.position = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn, CAST(l.lots * r.lot_size AS DOUBLE) AS qty,
    CASE r.slippage_model WHEN 'fixed_pts' THEN CASE WHEN l.position = 'sell' THEN greatest(raw_price - slippage_value, 0.01::DOUBLE) ELSE raw_price + slippage_value END
      WHEN 'percent' THEN CASE WHEN l.position = 'sell' THEN raw_price*(1-slippage_value/100) ELSE raw_price*(1+slippage_value/100) END ELSE raw_price END AS entry_price
  FROM picked p JOIN runs r ON r.run_id = p.run_id AND r.symbol = p.symbol JOIN legs l ON l.run_id = p.run_id AND l.leg_no = p.leg_no WHERE rk = 1)"""

MARKS_SQL = """
hz AS (SELECT run_id, symbol, entry_ts, coalesce(t, e) AS horizon, t IS NULL AS eod FROM (
    SELECT o.run_id, o.symbol, o.entry_ts, min(sp.ts) FILTER (sp.ts >= o.entry_ts AND sp.time >= o.exit_time) AS t, max(sp.ts) AS e
    FROM opened o JOIN spine sp ON sp.symbol = o.symbol GROUP BY ALL)),
grid AS (
  SELECT o.*, h.horizon, h.eod, sp.ts, b.close AS c0, b.spot AS s0, b.delta AS d0,
    CASE WHEN sp.ts = o.entry_ts THEN b.close ELSE greatest(b.high, b.close) END AS h0,
    CASE WHEN sp.ts = o.entry_ts THEN b.close ELSE least(b.low, b.close) END AS l0,
    (b.close - o.entry_price)*sgn*qty AS p0
  FROM opened o JOIN hz h ON h.run_id=o.run_id AND h.symbol=o.symbol AND h.entry_ts=o.entry_ts
  JOIN spine sp ON sp.symbol = o.symbol AND sp.ts BETWEEN o.entry_ts AND h.horizon
  LEFT JOIN b ON b.symbol = o.symbol AND b.ts = sp.ts AND b.option_type = o.option_type AND b.strike_offset = o.held_offset),
mk1 AS (
  SELECT *, last_value(c0 IGNORE NULLS) OVER w AS cl, last_value(s0 IGNORE NULLS) OVER w AS sp1, last_value(d0 IGNORE NULLS) OVER w AS dl1,
    CASE WHEN sgn < 0 THEN last_value(h0 IGNORE NULLS) OVER w ELSE last_value(l0 IGNORE NULLS) OVER w END AS worst,
    CASE WHEN sgn < 0 THEN last_value(l0 IGNORE NULLS) OVER w ELSE last_value(h0 IGNORE NULLS) OVER w END AS best,
    last_value(p0 IGNORE NULLS) OVER w AS pnl, count(c0) OVER w AS held,
    min(CASE WHEN trail_sl_enabled AND entry_price > 0 AND p0/(entry_price*qty)*100 >= trail_sl_activate_at THEN ts END) OVER w AS act
  FROM grid WINDOW w AS (PARTITION BY run_id, symbol, entry_ts, leg_no ORDER BY ts)),
mk2 AS (SELECT *, max(CASE WHEN ts >= act THEN p0 END) OVER (PARTITION BY run_id, symbol, entry_ts, leg_no ORDER BY ts) AS hw FROM mk1),
mk3 AS (
  SELECT *, coalesce(c0 IS NOT NULL AND ts > act AND CASE WHEN trail_sl_mode = 'lock' THEN p0 < hw*trail_sl_lock_in/100
      WHEN trail_sl_unit = 'points' THEN hw - p0 >= trail_sl_value*qty AND trail_sl_value*qty > 0
      ELSE hw - p0 >= hw*trail_sl_value/100 AND hw*trail_sl_value/100 > 0 END, FALSE)
    OR (stop_loss_enabled AND CASE stop_loss_type WHEN 'points' THEN (worst-entry_price)*-sgn >= stop_loss_value
      WHEN 'percent_of_premium' THEN -((worst-entry_price)*sgn)/entry_price*100 >= stop_loss_value
      WHEN 'percent_of_margin' THEN -((worst-entry_price)*sgn)/greatest(3*entry_price, 0.12::DOUBLE*entry_spot)*100 >= stop_loss_value
      WHEN 'index_points' THEN (sp1-entry_spot)*-sgn >= stop_loss_value
      WHEN 'delta_breach' THEN coalesce(dl1 <> 0 AND abs(dl1) >= stop_loss_value, FALSE) ELSE FALSE END) AS slh,
    (target_profit_enabled AND CASE target_profit_type WHEN 'points' THEN (best-entry_price)*sgn >= target_profit_value
      WHEN 'percent_of_premium' THEN (best-entry_price)*sgn/entry_price*100 >= target_profit_value ELSE FALSE END) AS tgh FROM mk2),
pb AS (
  SELECT run_id, symbol, entry_ts, ts, max(horizon) AS horizon, bool_or(eod) AS eod, bool_or(slh) AS slh, bool_or(tgh) AS tgh,
    sum(pnl ORDER BY leg_no) AS upnl, sum(entry_price*qty ORDER BY leg_no) AS prem, any_value(overall_sl_enabled) AS oe, any_value(overall_sl_type) AS ot, any_value(overall_sl_value) AS ov,
    any_value(overall_target_enabled) AS te, any_value(overall_target_type) AS tt, any_value(overall_target_value) AS tv
  FROM mk3 GROUP BY run_id, symbol, entry_ts, ts),
flagged AS (
  SELECT *, CASE WHEN slh THEN 'stop_loss'
    WHEN oe AND CASE ot WHEN 'percent_of_premium' THEN -upnl/prem*100 >= ov WHEN 'points' THEN -upnl >= ov WHEN 'combined_premium' THEN -upnl >= ov ELSE FALSE END THEN 'combined_sl'
    WHEN tgh THEN 'target'
    WHEN te AND CASE tt WHEN 'percent_of_premium' THEN upnl/prem*100 >= tv WHEN 'points' THEN upnl >= tv ELSE FALSE END THEN 'combined_target'
    WHEN ts = horizon AND eod THEN 'end_of_data' WHEN ts = horizon THEN 'time_exit' END AS reason FROM pb),
pos AS (SELECT run_id, symbol, entry_ts, min(ts) AS exit_ts, min_by(reason, ts) AS reason FROM flagged WHERE reason IS NOT NULL GROUP BY ALL),
nxt AS (SELECT p.*, (SELECT min(q.entry_ts) FROM pos q WHERE q.run_id=p.run_id AND q.symbol=p.symbol AND q.entry_ts > p.exit_ts) AS n FROM pos p),
taken AS (
  SELECT run_id, symbol, entry_ts, exit_ts, reason, n FROM nxt WHERE (run_id, symbol, entry_ts) IN (SELECT (run_id, symbol, min(entry_ts)) FROM pos GROUP BY run_id, symbol)
  UNION ALL SELECT x.run_id, x.symbol, x.entry_ts, x.exit_ts, x.reason, x.n FROM nxt x JOIN taken t ON x.run_id=t.run_id AND x.symbol=t.symbol AND x.entry_ts=t.n),
fills AS (
  SELECT g.*, t.exit_ts, t.reason, CASE WHEN t.reason = 'stop_loss' AND stop_loss_type IN ('points','percent_of_premium','percent_of_margin') THEN worst
      WHEN t.reason = 'target' THEN best ELSE cl END AS raw_exit
  FROM mk3 g JOIN taken t ON g.run_id=t.run_id AND g.symbol=t.symbol AND g.entry_ts=t.entry_ts AND g.ts=t.exit_ts),
f2 AS (
  SELECT *, CASE slippage_model WHEN 'fixed_pts' THEN CASE WHEN position = 'buy' THEN greatest(raw_exit - slippage_value, 0.01::DOUBLE) ELSE raw_exit + slippage_value END
      WHEN 'percent' THEN CASE WHEN position = 'buy' THEN raw_exit*(1-slippage_value/100) ELSE raw_exit*(1+slippage_value/100) END ELSE raw_exit END AS exit_price,
    brokerage_per_lot*lots*2 AS brokerage FROM fills),
f3 AS (
  SELECT *, (exit_price-entry_price)*sgn*qty AS pnl_gross,
    CASE WHEN stt_on_sell THEN (CASE WHEN position='sell' THEN entry_price ELSE exit_price END)*qty*0.000625::DOUBLE ELSE 0 END AS stt,
    CASE slippage_model WHEN 'fixed_pts' THEN slippage_value*qty*2 WHEN 'percent' THEN (entry_price+raw_exit)*slippage_value/100*qty ELSE 0 END AS slippage_cost,
    (entry_price+exit_price)*qty*(0.00053::DOUBLE+0.000001::DOUBLE)*1.18::DOUBLE + brokerage*0.18::DOUBLE
      + (CASE WHEN position='buy' THEN entry_price ELSE exit_price END)*qty*0.00003::DOUBLE AS other_charges FROM f2),
tr AS (SELECT *, pnl_gross - brokerage - stt - other_charges AS pnl_net FROM f3)"""

# A leg entered at a price of zero, or a position without premium, has lost and gained 0% of it, as in the query; x/0 is infinite here.
GUARDED_MARKS_SQL = MARKS_SQL.replace(
    "-((worst-entry_price)*sgn)/entry_price*100 >=", "CASE WHEN entry_price > 0 THEN -((worst-entry_price)*sgn)/entry_price*100 ELSE 0 END >="
).replace("(best-entry_price)*sgn/entry_price*100 >=", "CASE WHEN entry_price > 0 THEN (best-entry_price)*sgn/entry_price*100 ELSE 0 END >=").replace(
    "upnl/prem*100 >=", "CASE WHEN prem > 0 THEN upnl/prem*100 ELSE 0 END >="
)


def replay_sql(configs, select, b=PLAIN_B, config=None, marks=MARKS_SQL):
    # Only ``taken`` refers to itself.
    return f"WITH RECURSIVE {BARS_SQL}, {b}, {config or config_sql(configs)}, {OPEN_SQL}, {marks}\n{select}"


def sweep_config_sql(conf, grid):
    """Runs and legs of one strategy under a grid CTE ``g(i, sl, tv, so, lots)``."""
    flat = {k: v for k, v in conf.items() if k not in ("legs", "overall", "underlying")}
    run = {**RUN_DEFAULTS, **flat, **conf.get("overall", {}), "symbol": ""}
    legs = [{**LEG_DEFAULTS, **one, "run_id": conf["run_id"], "leg_no": no} for no, one in enumerate(conf["legs"])]
    return f"""{grid}, {_values('base_runs', RUNS, [run])}, {_values('base_legs', LEGS, legs)},
runs0 AS (SELECT r.* REPLACE (r.run_id || '#' || i AS run_id, tv AS overall_target_value, TRUE AS overall_target_enabled) FROM base_runs r, g),
legs AS (SELECT l.* REPLACE (l.run_id || '#' || i AS run_id, sl AS stop_loss_value, so AS strike_offset, g.lots AS lots) FROM base_legs l, g),
symbols AS (SELECT DISTINCT symbol FROM bars),
runs AS (SELECT r.* EXCLUDE (symbol), s.symbol FROM runs0 r, symbols s)"""


EXITS_SELECT = """SELECT run_id || '@' || symbol AS run_id, CAST(leg_no AS BIGINT) AS leg_no, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_at,
  strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_at, CAST(held_offset AS BIGINT) AS held_offset, reason AS exit_reason, CAST(held AS BIGINT) AS bars_held,
  round(entry_price,6) AS entry_price, round(exit_price,6) AS exit_price, round(pnl_gross,4) AS pnl_gross FROM tr"""

TRADES_SELECT = """SELECT run_id || '@' || symbol AS run_id, CAST(leg_no AS BIGINT) AS leg_no, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_at,
  strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_at, option_type, position AS position_side, round(entry_price,6) AS entry_price, round(exit_price,6) AS exit_price,
  round(entry_spot,6) AS entry_spot, round(sp1,6) AS exit_spot, CAST(lots AS BIGINT) AS lots, CAST(lot_size AS BIGINT) AS lot_size,
  round(pnl_gross,4) AS pnl_gross, round(pnl_net,10) AS pnl_net, round(brokerage,4) AS brokerage, round(stt,10) AS stt, round(slippage_cost,8) AS slippage_cost,
  round(other_charges,10) AS other_charges, reason AS exit_reason, CAST(held AS BIGINT) AS bars_held, CAST(0 AS BIGINT) AS reentry_attempt FROM tr"""


def _stamp(name):
    return F.substring(F.col(name).cast("string"), 1, 19)


def exits_query(configs, marks=GUARDED_MARKS_SQL):
    def query(spark, sf):
        t = R.replay(*frames(spark, sf, configs)).trades
        return text_dates(
            t.select(
                "run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"),
                "held_offset", "exit_reason", "bars_held", "entry_price", "exit_price", "pnl_gross",
            ),
            {"pnl_gross": 4},
        )

    return query, replay_sql(configs, EXITS_SELECT, marks=marks)


def closed_trades(spark, sf):
    t = R.replay(*frames(spark, sf, COSTS)).trades
    return text_dates(
        t.select(
            "run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"), "option_type", "position_side",
            "entry_price", "exit_price", "entry_spot", "exit_spot", "lots", "lot_size", "pnl_gross", "pnl_net", "brokerage", "stt",
            "slippage_cost", "other_charges", "exit_reason", "bars_held", "reentry_attempt",
        ),
        {"pnl_gross": 4, "pnl_net": 10, "brokerage": 4, "stt": 10, "slippage_cost": 8, "other_charges": 10},
    )


def spine_query(spark, sf):
    s = with_ordinals(bar_spine(bars(spark, sf)))
    return text_dates(s.select("symbol", "date", "time", "spot", "ord"))


SPINE_SQL = f"""WITH {BARS_SQL}, s AS (SELECT symbol, date, time, min_by(spot, (strike_offset, option_type)) AS spot FROM bars GROUP BY ALL)
SELECT symbol, CAST(date AS VARCHAR) AS date, time, round(spot,6) AS spot, row_number() OVER (PARTITION BY symbol ORDER BY date, time) AS ord FROM s"""


def select_query(spark, sf):
    b, runs, legs = frames(spark, sf, SELECTION)
    got = select_contract(entry_candidates(bar_spine(b), runs), legs, b, runs.select(F.col("entry_time").alias("time")))
    return text_dates(got.select("run_id", "date", "time", "leg_no", "option_type", "held_offset", "raw_price", "entry_spot"))


SELECT_SQL = f"""WITH {BARS_SQL}, {PLAIN_B}, {config_sql(SELECTION)}, {OPEN_SQL}
SELECT run_id || '@' || symbol AS run_id, strftime(entry_ts, '%Y-%m-%d') AS date, strftime(entry_ts, '%H:%M:%S') AS time, CAST(leg_no AS BIGINT) AS leg_no,
  option_type, CAST(held_offset AS BIGINT) AS held_offset, round(raw_price,6) AS raw_price, round(entry_spot,6) AS entry_spot FROM opened"""


def marks_query(spark, sf):
    b, runs, legs = frames(spark, sf, SELECTION)
    spine = bar_spine(b)
    opened = R.open_legs(entry_candidates(spine, runs), runs, legs, b)
    m = R.mark_positions(R.with_horizon(opened, horizons(spine, runs)), b)
    return text_dates(m.select("run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("ts").alias("at"), "close", "worst", "best", "spot", "pnl"), {"pnl": 4})


MARKS_SELECT = f"""WITH RECURSIVE {BARS_SQL}, {PLAIN_B}, {config_sql(SELECTION)}, {OPEN_SQL}, {MARKS_SQL}
SELECT run_id || '@' || symbol AS run_id, CAST(leg_no AS BIGINT) AS leg_no, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
  c0 AS close, worst, best, round(s0,6) AS spot, round(p0,4) AS pnl FROM mk3 WHERE c0 IS NOT NULL"""


def equity_query(spark, sf):
    e = R.replay(*frames(spark, sf, COSTS + CARRIED)).equity()
    return text_dates(e.select("run_id", "date", "time", "spot", "unrealized_pnl", "cumulative_pnl", "equity"), {"unrealized_pnl": 4, "cumulative_pnl": 5, "equity": 5})


EQUITY_SELECT = """, done AS (SELECT run_id, symbol, exit_ts AS ts, sum(pnl_net) AS net FROM tr WHERE reason <> 'end_of_data' GROUP BY ALL),
open_pnl AS (SELECT f.run_id, f.symbol, f.ts, CASE WHEN f.ts = t.exit_ts AND t.reason <> 'end_of_data' THEN 0 ELSE f.upnl END AS u
  FROM flagged f JOIN taken t ON f.run_id=t.run_id AND f.symbol=t.symbol AND f.entry_ts=t.entry_ts AND f.ts <= t.exit_ts),
eq AS (SELECT r.run_id, r.symbol, sp.date, sp.time, sp.spot, r.capital, coalesce(o.u,0) AS u,
    coalesce(sum(d.net) OVER (PARTITION BY r.run_id, r.symbol ORDER BY sp.ts),0) AS cum
  FROM runs r JOIN spine sp ON sp.symbol=r.symbol LEFT JOIN open_pnl o ON o.run_id=r.run_id AND o.symbol=r.symbol AND o.ts=sp.ts
  LEFT JOIN done d ON d.run_id=r.run_id AND d.symbol=r.symbol AND d.ts=sp.ts)
SELECT run_id || '@' || symbol AS run_id, CAST(date AS VARCHAR) AS date, time, round(spot,6) AS spot, round(u,4)+0.0 AS unrealized_pnl,
  round(cum,5)+0.0 AS cumulative_pnl, round(capital+cum+u,5) AS equity FROM eq"""


def daily_equity_query(spark, sf):
    e = R.replay(*frames(spark, sf, COSTS + CARRIED)).daily_equity()
    return text_dates(e.select("run_id", "date", "equity"), {"equity": 5})


DAILY_SELECT = EQUITY_SELECT.split("SELECT run_id || '@'")[0] + """
SELECT run_id || '@' || symbol AS run_id, CAST(date AS VARCHAR) AS date, round(max_by(capital+cum+u, time),5) AS equity FROM eq GROUP BY run_id, symbol, date"""


def spot_signals(b):
    """A direction for every bar time, by the index points of its spot."""
    rest = F.floor("spot") % 3
    return bar_spine(b).select("symbol", "date", "time", F.when(rest == 0, "bullish").when(rest == 1, "bearish").otherwise("neutral").alias("signal"))


# Every bar time is tried as an entry; then one state for each run walks over the bars.
REENTRY_SQL = f"""WITH RECURSIVE {BARS_SQL}, {PLAIN_B}, {config_sql(REENTRY)}, {OPEN_SQL.replace("sp.time = r.entry_time", "TRUE")}, {MARKS_SQL.split("nxt AS")[0]}
so AS MATERIALIZED (SELECT symbol, ts, time, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS ord,
  CASE CAST(floor(spot) AS BIGINT) % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS sig FROM spine),
px AS MATERIALIZED (SELECT p.run_id, p.symbol, e.ord, x.ord AS x_ord, p.reason, p.entry_ts, p.exit_ts
  FROM pos p JOIN so e ON e.symbol = p.symbol AND e.ts = p.entry_ts JOIN so x ON x.symbol = p.symbol AND x.ts = p.exit_ts),
r0 AS MATERIALIZED (
  SELECT r.run_id, r.symbol, any_value(r.entry_time) AS entry_time, bool_or(l.reentry_mode = 'same_time') AS same,
    list(struct_pack(mode := l.reentry_mode, n := l.reentry_cooldown_bars, most := l.reentry_max_attempts, on_sl := l.reentry_on_sl, on_tg := l.reentry_on_target,
      agrees := CASE WHEN l.position = 'sell' THEN 'bearish' ELSE 'bullish' END, state := 'idle', left_ := 0, done := 0)) FILTER (l.reentry_on_sl OR l.reentry_on_target) AS trk
  FROM runs r JOIN legs l ON l.run_id = r.run_id GROUP BY r.run_id, r.symbol),
walk(run_id, symbol, entry_time, same, ord, trk, armed, n, x_ord, reason, entered, label) AS (
  SELECT run_id, symbol, entry_time, same, CAST(0 AS BIGINT), trk, FALSE, 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), FALSE, 0 FROM r0
  UNION ALL
  SELECT run_id, symbol, entry_time, same, ord, trk, CASE WHEN x_ord = ord THEN len(list_filter(trk, lambda x: x.state <> 'idle')) > 0 ELSE armed END,
    n, CASE WHEN x_ord = ord THEN NULL ELSE x_ord END, reason, entered, label
  FROM (
    SELECT * REPLACE (CASE WHEN x_ord = ord THEN list_transform(trk, lambda x: CASE
        WHEN x.state = 'idle' AND x.done < x.most AND ((x.on_sl AND reason IN ('stop_loss','combined_sl')) OR (x.on_tg AND reason IN ('target','combined_target')))
        THEN struct_pack(mode := x.mode, n := x.n, most := x.most, on_sl := x.on_sl, on_tg := x.on_tg, agrees := x.agrees,
          state := CASE WHEN x.mode = 'momentum_confirm' THEN 'waiting' WHEN x.mode = 'after_n_bars' AND x.n > 0 THEN 'cooling' ELSE 'ready' END, left_ := x.n, done := x.done)
        ELSE x END) ELSE trk END AS trk)
    FROM (
      SELECT run_id, symbol, entry_time, same, ord,
        CASE WHEN go AND armed THEN list_transform(trk, lambda x: CASE WHEN x.state = 'ready'
          THEN struct_pack(mode := x.mode, n := x.n, most := x.most, on_sl := x.on_sl, on_tg := x.on_tg, agrees := x.agrees, state := 'idle', left_ := 0, done := x.done + 1)
          ELSE x END) ELSE trk END AS trk,
        armed AND NOT go AS armed, n + CASE WHEN go AND armed THEN 1 ELSE 0 END AS n,
        CASE WHEN go THEN p_ord ELSE x_ord END AS x_ord, CASE WHEN go THEN p_reason ELSE reason END AS reason, go AS entered,
        CASE WHEN go AND armed THEN n + 1 ELSE 0 END AS label
      FROM (
        SELECT *, x_ord IS NULL AND p_ord IS NOT NULL AND CASE WHEN armed THEN len(list_filter(trk, lambda x: x.state = 'ready')) > 0 AND (NOT same OR time = entry_time)
          ELSE time = entry_time END AS go
        FROM (
          SELECT w.run_id, w.symbol, w.entry_time, w.same, s.ord, s.time, w.armed, w.n, w.x_ord, w.reason, p.x_ord AS p_ord, p.reason AS p_reason,
            CASE WHEN w.armed AND w.x_ord IS NULL THEN list_transform(w.trk, lambda x: CASE
              WHEN x.state = 'cooling' OR (x.state = 'waiting' AND s.sig = x.agrees) THEN struct_pack(mode := x.mode, n := x.n, most := x.most, on_sl := x.on_sl,
                on_tg := x.on_tg, agrees := x.agrees, state := CASE WHEN x.state = 'cooling' AND x.left_ > 1 THEN 'cooling' ELSE 'ready' END, left_ := x.left_ - 1, done := x.done)
              ELSE x END) ELSE w.trk END AS trk
          FROM walk w JOIN so s ON s.symbol = w.symbol AND s.ord = w.ord + 1
          LEFT JOIN px p ON p.run_id = w.run_id AND p.symbol = w.symbol AND p.ord = s.ord))))),
taken AS (SELECT p.run_id, p.symbol, p.entry_ts, p.exit_ts, p.reason, w.label FROM walk w JOIN px p ON p.run_id = w.run_id AND p.symbol = w.symbol AND p.ord = w.ord WHERE w.entered),
fills AS ({MARKS_SQL.split("fills AS (")[1].replace("t.reason, CASE", "t.reason, t.label, CASE")}
SELECT run_id || '@' || symbol AS run_id, CAST(leg_no AS BIGINT) AS leg_no, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_at,
  strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_at, reason AS exit_reason, CAST(label AS BIGINT) AS reentry_attempt, round(pnl_net,6) AS pnl_net FROM tr"""


def reentry_query(spark, sf):
    b, runs, legs = frames(spark, sf, REENTRY)
    t = R.replay(b, runs, legs, spot_signals(b)).trades
    return text_dates(
        t.select("run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"), "exit_reason", "reentry_attempt", "pnl_net")
    )


# ------------------------------------------------------------------ expiries and replay options

EXPIRIES = [
    strategy("weekly", [leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 80))], exit_time="23:30:00"),
    strategy("by_filter", [leg("CE", strike_mode="percent_otm", **sl("percent_of_premium", 80))], exit_time="23:30:00", expiry_filter="monthly"),
    strategy("calendar", [leg("PE", expiry="weekly", strike_mode="percent_otm"), leg("PE", BUY, expiry="monthly", strike_mode="percent_otm", **target("percent_of_premium", 50))],
             trade_on_expiry=False),
    strategy("trailing", [leg("PE", expiry="monthly", **trail("lock", 20, trail_sl_lock_in=50.0))], exit_time="23:30:00"),
    strategy("again", [leg("CE", expiry="monthly", strike_offset=1, **sl("percent_of_premium", 40))]),
]


def two_expiries(b):
    """Weekly bars as they are, and monthly ones of the same offsets at other prices, at every other bar time."""
    far = b.where(F.substring("time", 1, 2).cast("int") % 2 == 1)
    far = far.select(*[(F.col(n) + F.lit(7.0)).alias(n) if n in ("open", "high", "low", "close") else n for n in b.columns])
    return b.withColumn("expiry_type", F.lit("weekly")).unionByName(far.withColumn("expiry_type", F.lit("monthly")))


def expiry_rules_of(symbols):
    """Weekly expiries on Wednesdays and monthly ones on the last Thursday, by symbol."""
    kinds = [("weekly", "Wednesday"), ("monthly", "last_thursday")]
    rules = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(d).alias("day")) for t, d in kinds])
    return symbols.select(
        "symbol", F.lit("1990-01-01").cast("date").alias("from_date"), F.lit("2099-12-31").cast("date").alias("to_date"), F.inline(rules)
    )


def expiry_query(spark, sf):
    b, runs, legs = frames(spark, sf, EXPIRIES)
    b = cut_lineage(two_expiries(b))
    rules = expiry_rules_of(b.select("symbol").distinct())
    t = R.replay(b, runs, legs, expiry_rules=rules).trades
    return text_dates(
        t.select(
            "run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"),
            "held_offset", "exit_reason", "bars_held", "entry_price", "exit_price", "pnl_gross",
        ),
        {"pnl_gross": 4},
    )


TWO_B = """two AS (
  SELECT *, 'weekly' AS kind FROM bars
  UNION ALL SELECT * REPLACE (open+7 AS open, high+7 AS high, low+7 AS low, close+7 AS close), 'monthly' FROM bars WHERE CAST(time[1:2] AS INT) % 2 = 1),
two_m AS (SELECT *, last_day(date) - CAST((isodow(last_day(date)) - 4 + 7) % 7 AS INT) AS e0, last_day(CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE)) AS l1 FROM two),
b AS (SELECT *, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS delta,
  CAST(CASE WHEN kind = 'weekly' THEN date + CAST((3 - isodow(date) + 7) % 7 AS INT) WHEN date <= e0 THEN e0 ELSE l1 - CAST((isodow(l1) - 4 + 7) % 7 AS INT) END AS DATE) AS due FROM two_m)"""


def expiry_sql():
    """The replay rules with the expiry type among what a leg asks for and the due date among what it holds."""
    opening = OPEN_SQL.replace("b.spot AS entry_spot,", "b.spot AS entry_spot, b.kind AS held_kind, b.due AS held_due,").replace(
        "AND b.option_type = l.option_type", "AND b.option_type = l.option_type AND b.kind = coalesce(l.expiry, r.expiry_filter)"
    )
    # The gate asks the earliest-starting rule, the weekly one of two that start together.
    gate = "r.entry_time AND (r.trade_on_expiry OR isodow(sp.date) <> 3)"
    marks = GUARDED_MARKS_SQL.replace("AND b.strike_offset = o.held_offset", "AND b.strike_offset = o.held_offset AND b.kind = o.held_kind AND b.due = o.held_due")
    return f"WITH RECURSIVE {BARS_SQL}, {TWO_B}, {config_sql(EXPIRIES)}, {opening.replace('r.entry_time JOIN', gate + ' JOIN')}, {marks}\n{EXITS_SELECT}"


def options_query(spark, sf):
    """Dated lots, an entry filter and strike tracking in one replay."""
    b, runs, legs = frames(spark, sf, CARRIED + COSTS)
    runs = runs.withColumn("lot_size", F.when(F.col("run_id").startswith("until"), F.lit(None).cast("int")).otherwise(F.col("lot_size")))
    symbols = b.select("symbol").distinct()
    lots = symbols.select("symbol", F.inline(F.array(*[
        F.struct(F.lit(f).cast("date").alias("from_date"), F.lit(t).cast("date").alias("to_date"), F.lit(n).alias("size"))
        for f, t, n in (("1990-01-01", "2024-01-15", 25), ("2024-01-16", "2099-12-31", 40))
    ])))
    allowed = runs.join(b.select("symbol", "date").distinct(), "symbol").where(F.dayofmonth("date") % 2 == 1)
    allowed = allowed.select("run_id", "date", F.col("entry_time").alias("time"))
    t = R.replay(b, runs, legs, lot_rules=lots, entry_filter=allowed, track_by="strike").trades
    return text_dates(
        t.select(
            "run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"), "lot_size",
            "held_offset", "exit_reason", "bars_held", "entry_price", "exit_price", "pnl_gross",
        ),
        {"pnl_gross": 4},
    )


OPTIONS_SQL = replay_sql(CARRIED + COSTS, EXITS_SELECT.replace("CAST(held_offset", "CAST(lot_size AS BIGINT) AS lot_size, CAST(held_offset"), marks=GUARDED_MARKS_SQL).replace(
    "sp.time = r.entry_time JOIN", "sp.time = r.entry_time AND day(sp.date) % 2 = 1 JOIN"
).replace("r.* EXCLUDE (run_id, symbol)", """r.* EXCLUDE (run_id, symbol) REPLACE (CASE WHEN r.run_id LIKE 'until%' THEN CASE WHEN p.entry_ts < TIMESTAMP '2024-01-16' THEN 25 ELSE 40 END ELSE r.lot_size END AS lot_size)""").replace(
    "CAST(l.lots * r.lot_size AS DOUBLE)", "CAST(l.lots * CASE WHEN r.run_id LIKE 'until%' THEN CASE WHEN p.entry_ts < TIMESTAMP '2024-01-16' THEN 25 ELSE 40 END ELSE r.lot_size END AS DOUBLE)"
).replace("b.strike_offset AS held_offset,", "b.strike_offset AS held_offset, b.strike AS held_strike,").replace("b.strike_offset = o.held_offset", "b.strike = o.held_strike")


ENTRIES = {
    "D01_bar_spine": (spine_query, SPINE_SQL),
    "C01_C03_D02_select_contract": (select_query, SELECT_SQL),
    "C05_D04_mark_positions": (marks_query, MARKS_SELECT),
    "D05_D10_D17_leg_stops": exits_query(LEG_STOPS),
    "D11_leg_targets": exits_query(TARGETS),
    "D12_D14_trailing_stops": exits_query(TRAILING),
    "D15_D16_overall_exits": exits_query(OVERALL, MARKS_SQL),
    "D18_D26_carried_positions": exits_query(CARRIED),
    "D03_D19_D25_closed_trades": (closed_trades, replay_sql(COSTS, TRADES_SELECT)),
    "D31_equity_snapshots": (equity_query, replay_sql(COSTS + CARRIED, EQUITY_SELECT, marks=GUARDED_MARKS_SQL)),
    "F05_daily_equity": (daily_equity_query, replay_sql(COSTS + CARRIED, DAILY_SELECT, marks=GUARDED_MARKS_SQL)),
    "D27_D30_reentries": (reentry_query, REENTRY_SQL),
    "C01_D33_expiries": (expiry_query, expiry_sql()),
    "C06_D32_replay_options": (options_query, OPTIONS_SQL),
}

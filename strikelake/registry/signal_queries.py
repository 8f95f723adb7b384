"""Registered queries: momentum signals, greeks, surface and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..operators import signals as S
from ..operators.contracts import bar_spine, entry_candidates
from ..operators.surface import iv_at, iv_surface
from ..plans import replay as R
from ..session import cut_lineage
from .inputs import BARS_SQL, TRADES_SQL, bars, text_dates, trades
from .replay_queries import EXITS_SELECT, _stamp, frames, leg, replay_sql, sl, strategy

SPINE_CTE = f"""{BARS_SQL}, spine0 AS (SELECT symbol, date, time, min_by(spot, (strike_offset, option_type)) AS spot FROM bars GROUP BY ALL),
spine AS (SELECT *, row_number() OVER w AS ord, spot - lag(spot) OVER w AS chg FROM spine0 WINDOW w AS (PARTITION BY symbol ORDER BY date, time))"""


def _spine(spark, sf):
    return cut_lineage(bar_spine(bars(spark, sf)))


def rsi_signal(spark, sf):
    return text_dates(S.rsi_signal(_spine(spark, sf), 14, 55.0, 45.0).select("symbol", "date", "time", "rsi", "signal"))


RSI_SQL = f"""WITH RECURSIVE {SPINE_CTE},
seed AS (SELECT symbol, sum(greatest(chg,0))/14 AS g, sum(greatest(-chg,0))/14 AS l FROM spine WHERE ord BETWEEN 2 AND 15 GROUP BY symbol),
r AS (SELECT symbol, CAST(15 AS BIGINT) AS ord, g, l FROM seed
  UNION ALL SELECT r.symbol, s.ord, (r.g*13+greatest(s.chg,0))/14, (r.l*13+greatest(-s.chg,0))/14 FROM r JOIN spine s ON s.symbol=r.symbol AND s.ord=r.ord+1),
v AS (SELECT s.symbol, CAST(date AS VARCHAR) AS date, time, CASE WHEN r.l IS NULL THEN NULL WHEN r.l=0 THEN 100.0 ELSE 100.0-100.0/(1.0+r.g/r.l) END AS rsi
  FROM spine s LEFT JOIN r ON r.symbol=s.symbol AND r.ord=s.ord)
SELECT symbol, date, time, round(rsi,6) AS rsi, CASE WHEN rsi>55 THEN 'bullish' WHEN rsi<45 THEN 'bearish' ELSE 'neutral' END AS signal FROM v"""


def ema_cross_signal(spark, sf):
    return text_dates(S.ema_cross_signal(_spine(spark, sf), 9, 21).select("symbol", "date", "time", "ema_fast", "ema_slow", "signal"))


EMA_SQL = f"""WITH RECURSIVE {SPINE_CTE},
r AS (SELECT symbol, ord, date, time, spot AS f, spot AS s FROM spine WHERE ord=1
  UNION ALL SELECT r.symbol, s.ord, s.date, s.time, s.spot*0.2::DOUBLE + r.f*0.8::DOUBLE, s.spot*(2.0::DOUBLE/22) + r.s*(1-2.0::DOUBLE/22) FROM r JOIN spine s ON s.symbol=r.symbol AND s.ord=r.ord+1)
SELECT symbol, CAST(date AS VARCHAR) AS date, time, round(f,6) AS ema_fast, round(s,6) AS ema_slow,
  CASE WHEN f>s THEN 'bullish' WHEN f<s THEN 'bearish' ELSE 'neutral' END AS signal FROM r"""


def range_breakout_signal(spark, sf):
    s = S.range_breakout_signal(_spine(spark, sf), "10:00:00")
    return text_dates(s.select("symbol", "date", "time", "range_high", "range_low", "signal"))


RANGE_SQL = f"""WITH {SPINE_CTE}, d AS (SELECT symbol, date, max(spot) FILTER (time <= '10:00:00') AS h, min(spot) FILTER (time <= '10:00:00') AS l FROM spine GROUP BY symbol, date)
SELECT symbol, CAST(date AS VARCHAR) AS date, time, round(h,6) AS range_high, round(l,6) AS range_low,
  CASE WHEN time > '10:00:00' AND spot > h THEN 'bullish' WHEN time > '10:00:00' AND spot < l THEN 'bearish' ELSE 'neutral' END AS signal
FROM spine JOIN d USING (symbol, date)"""


def supertrend_signal(spark, sf):
    s = S.supertrend_signal(_spine(spark, sf), 7, 0.8)
    return text_dates(s.select("symbol", "date", "time", "atr", "upper", "lower", "signal"))


SUPERTREND_SQL = f"""WITH RECURSIVE {SPINE_CTE},
seed AS (SELECT symbol, sum(abs(chg))/7 AS a FROM spine WHERE ord BETWEEN 2 AND 8 GROUP BY symbol),
r AS (SELECT s.symbol, s.ord, s.date, s.time, a AS atr, spot + 0.8::DOUBLE*a AS up, spot - 0.8::DOUBLE*a AS lo, TRUE AS trend FROM seed JOIN spine s ON s.symbol=seed.symbol AND s.ord=8
  UNION ALL
  SELECT symbol, ord, date, time, atr, up, lo, CASE WHEN spot > up THEN TRUE WHEN spot < lo THEN FALSE ELSE trend END FROM (
    SELECT s.symbol, s.ord, s.date, s.time, s.spot, (r.atr*6+abs(s.chg))/7 AS atr, least(r.up, s.spot+0.8::DOUBLE*(r.atr*6+abs(s.chg))/7) AS up,
      greatest(r.lo, s.spot-0.8::DOUBLE*(r.atr*6+abs(s.chg))/7) AS lo, r.trend FROM r JOIN spine s ON s.symbol=r.symbol AND s.ord=r.ord+1))
SELECT s.symbol, CAST(s.date AS VARCHAR) AS date, s.time, round(r.atr,6) AS atr, round(up,6) AS upper, round(lo,6) AS lower,
  CASE WHEN r.trend IS NULL THEN 'neutral' WHEN r.trend THEN 'bullish' ELSE 'bearish' END AS signal
FROM spine s LEFT JOIN r ON r.symbol=s.symbol AND r.ord=s.ord"""

GATED = [strategy("gated", [leg("CE", strike_mode="percent_otm")], entry_time="12:00:00")]


def momentum_gate(spark, sf):
    b, runs, _ = frames(spark, sf, GATED)
    spine = bar_spine(b)
    wanted = runs.select("run_id", F.lit("bullish").alias("direction"))
    kept = S.momentum_entries(entry_candidates(spine, runs), S.range_breakout_signal(spine, "10:00:00"), wanted)
    return text_dates(kept.select("run_id", "date", "time"))


MOMENTUM_SQL = f"""WITH {SPINE_CTE}, d AS (SELECT symbol, date, max(spot) FILTER (time <= '10:00:00') AS h FROM spine GROUP BY symbol, date)
SELECT 'gated@' || symbol AS run_id, CAST(date AS VARCHAR) AS date, time FROM spine JOIN d USING (symbol, date) WHERE time='12:00:00' AND spot > h"""


# ------------------------------------------------------------------ greeks


def _poly(coefficients, x):
    text = repr(coefficients[0])
    for k in coefficients[1:]:
        text = f"({text}::DOUBLE*{x}+{k!r}::DOUBLE)" if "*" not in text else f"({text}*{x}+{k!r}::DOUBLE)"
    return text


def cdf_sql(x):
    """Normal distribution function as text, from the same published coefficients."""
    a = f"abs({x})"
    e = f"exp(-({x})*({x})/2)"
    body = f"{e}*{_poly(P.CDF_NUMERATOR, a)}/{_poly(P.CDF_DENOMINATOR, a)}"
    tail = f"{e}/({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65::DOUBLE)))))/{P.CDF_TAIL}::DOUBLE"
    up = f"(CASE WHEN {a}>37 THEN 0 WHEN {a}<{P.CDF_SPLIT}::DOUBLE THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN {x}>0 THEN 1-{up} ELSE {up} END)"


def greeks_sql(source, spot, strike, tte, iv):
    """CTEs g1..g3 over ``source`` adding delta, gamma, theta, vega and price for live rows."""
    return f"""
g1 AS (SELECT *, (ln({spot}/{strike})+(0.065::DOUBLE+{iv}*{iv}/2)*({tte}))/({iv}*sqrt({tte})) AS d1 FROM {source}),
g2 AS (SELECT *, d1-{iv}*sqrt({tte}) AS d2, exp(-0.065::DOUBLE*({tte})) AS disc, exp(-d1*d1/2)/sqrt(2*pi()) AS pdf FROM g1),
g3 AS (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2, {cdf_sql('(-d1)')} AS m1, {cdf_sql('(-d2)')} AS m2 FROM g2),
g4 AS (SELECT *, CASE WHEN option_type='CE' THEN {spot}*n1-{strike}*disc*n2 ELSE {strike}*disc*m2-{spot}*m1 END AS price,
  CASE WHEN option_type='CE' THEN n1 ELSE n1-1 END AS delta, pdf/({spot}*{iv}*sqrt({tte})) AS gamma,
  (-({spot}*pdf*{iv})/(2*sqrt({tte})) + CASE WHEN option_type='CE' THEN -0.065::DOUBLE*{strike}*disc*n2 ELSE 0.065::DOUBLE*{strike}*disc*m2 END)/365.25::DOUBLE AS theta,
  {spot}*pdf*sqrt({tte})/100 AS vega FROM g3)"""


GREEK_KEYS = ["symbol", "date", "time", "option_type", "strike_offset"]


def _priced_bars(b):
    return P.with_greeks(b.withColumn("dte", (F.lit(7) - F.dayofmonth("date") % 7).cast("double")))


def greeks(spark, sf):
    g = _priced_bars(bars(spark, sf)).select(*GREEK_KEYS, "delta", "gamma", "theta", "vega")
    return text_dates(g, {"gamma": 10})


GREEKS_SQL = f"""WITH {BARS_SQL}, src AS (SELECT *, CAST(7 - day(date) % 7 AS DOUBLE) AS dte FROM bars WHERE iv > 0),
{greeks_sql('src', 'spot', 'strike', 'dte/365.25::DOUBLE', 'iv')}
SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, b.time, b.option_type, CAST(b.strike_offset AS BIGINT) AS strike_offset,
  coalesce(round(delta,6)+0.0,0) AS delta, coalesce(round(gamma,10)+0.0,0) AS gamma, coalesce(round(theta,6)+0.0,0) AS theta, coalesce(round(vega,6)+0.0,0) AS vega
FROM bars b LEFT JOIN g4 USING (symbol, date, time, option_type, strike_offset)"""


def option_prices(spark, sf):
    t = trades(spark, sf)
    c = F.col
    p = P.bs_columns(t, c("entry_spot"), c("strike"), c("dte_at_entry") / 365.25, c("entry_iv"), c("option_type"))
    return text_dates(
        p.groupBy("run_id", "option_type").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in ("price", "delta", "gamma", "theta", "vega")],
            F.avg(P.norm_cdf(F.col("entry_iv"))).alias("cdf"), F.avg(P.norm_pdf(F.col("entry_iv"))).alias("pdf"),
        ),
        {"gamma": 10},
    )


PRICES_SQL = f"""WITH {TRADES_SQL}, live AS (SELECT *, dte_at_entry/365.25::DOUBLE AS tte FROM trades WHERE dte_at_entry > 0),
{greeks_sql('live', 'entry_spot', 'strike', 'tte', 'entry_iv')},
al AS (SELECT run_id, option_type, entry_iv, price, delta, gamma, theta, vega FROM g4 UNION ALL
  SELECT run_id, option_type, entry_iv, CASE WHEN option_type='CE' THEN greatest(entry_spot-strike,0) ELSE greatest(strike-entry_spot,0) END,
   CASE WHEN option_type='CE' THEN CASE WHEN entry_spot>strike THEN 1 ELSE 0 END ELSE CASE WHEN entry_spot<strike THEN -1 ELSE 0 END END, 0, 0, 0 FROM trades WHERE dte_at_entry <= 0)
SELECT CAST(run_id AS BIGINT) AS run_id, option_type, count(*) AS n, round(avg(price),6) AS price, round(avg(delta),6) AS delta, round(avg(gamma),10) AS gamma,
  round(avg(theta),6) AS theta, round(avg(vega),6) AS vega, round(avg({cdf_sql('entry_iv')}),6) AS cdf, round(avg(exp(-entry_iv*entry_iv/2)/sqrt(2*pi())),6) AS pdf
FROM al GROUP BY run_id, option_type"""


def _attributed(t):
    # A long chain of expressions a row: dealt by key, so that few splits are not few tasks.
    t = t.repartition("orderkey")
    return P.pnl_attribution(t.withColumn("actual_pnl", F.col("pnl_net") / 10000))


def attribution(spark, sf):
    a = _attributed(trades(spark, sf))
    keys = ["run_id", "exit_date", "orderkey", "linenumber", "partkey", "suppkey", "price_cents"]
    return text_dates(
        a.select(*keys, "delta_pnl", "gamma_pnl", "theta_pnl", "vega_pnl", "total_attributed", "unexplained", "attribution_error_pct"),
        {"attribution_error_pct": 3},
        5,
    )


_ATTR = f"""{TRADES_SQL}, src AS (SELECT *, dte_at_entry/365.25::DOUBLE AS tte, pnl_net/10000 AS actual_pnl,
  CASE WHEN position_side='buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn, CAST(lots*lot_size AS DOUBLE) AS qty, exit_spot-entry_spot AS mv FROM trades),
live AS (SELECT * FROM src WHERE tte > 0), {greeks_sql('live', 'entry_spot', 'strike', 'tte', 'entry_iv')},
al AS (SELECT run_id, exit_date, orderkey, linenumber, partkey, suppkey, price_cents, actual_pnl, sgn, qty, mv, entry_iv, exit_iv, days_held, delta, gamma, theta, vega FROM g4
  UNION ALL SELECT run_id, exit_date, orderkey, linenumber, partkey, suppkey, price_cents, actual_pnl, sgn, qty, mv, entry_iv, exit_iv, days_held,
   CASE WHEN option_type='CE' THEN CASE WHEN entry_spot>strike THEN 1 ELSE 0 END ELSE CASE WHEN entry_spot<strike THEN -1 ELSE 0 END END, 0, 0, 0 FROM src WHERE tte <= 0),
at0 AS (SELECT *, sgn*delta*mv*qty AS dp, sgn*0.5*gamma*mv*mv*qty AS gp, sgn*theta*days_held*qty AS tp, sgn*vega*(exit_iv-entry_iv)*100*qty AS vp FROM al),
at1 AS (SELECT *, dp+gp+tp+vp AS tot, actual_pnl-(dp+gp+tp+vp) AS une FROM at0),
at2 AS (SELECT *, CASE WHEN abs(actual_pnl)>0.001 THEN abs(une)/abs(actual_pnl)*100 ELSE 0 END AS err FROM at1)"""

ATTRIBUTION_SQL = f"""WITH {_ATTR} SELECT CAST(run_id AS BIGINT) AS run_id, CAST(exit_date AS VARCHAR) AS exit_date, orderkey, CAST(linenumber AS BIGINT) AS linenumber,
  partkey, suppkey, price_cents, round(dp,5)+0.0 AS delta_pnl, round(gp,5)+0.0 AS gamma_pnl, round(tp,5)+0.0 AS theta_pnl, round(vp,5)+0.0 AS vega_pnl,
  round(tot,5)+0.0 AS total_attributed, round(une,5)+0.0 AS unexplained, round(err,3) AS attribution_error_pct FROM at2"""


def attribution_summary(spark, sf):
    return text_dates(P.attribution_summary(_attributed(trades(spark, sf)), ["run_id"]), None, 3)


ATTR_SUMMARY_SQL = f"""WITH {_ATTR} SELECT CAST(run_id AS BIGINT) AS run_id, round(sum(dp),3) AS total_delta_pnl, round(sum(gp),3) AS total_gamma_pnl, round(sum(tp),3) AS total_theta_pnl,
  round(sum(vp),3) AS total_vega_pnl, round(sum(une),3) AS total_unexplained, round(avg(err),3) AS avg_attribution_error_pct FROM at2 GROUP BY run_id"""


def surface_points(spark, sf):
    s = iv_surface(bars(spark, sf))
    return text_dates(s.select("symbol", "date", "time", F.inline("points")))


SURFACE_SQL = f"""WITH {BARS_SQL}, p AS (SELECT symbol, date, time, strike_offset, min_by(iv, option_type) AS iv FROM bars WHERE iv > 0 GROUP BY ALL)
SELECT symbol, CAST(date AS VARCHAR) AS date, time, CAST(strike_offset AS DOUBLE) AS "offset", round(iv,6) AS iv FROM p
QUALIFY count(*) OVER (PARTITION BY symbol, date, time) >= 3"""


def surface_values(spark, sf):
    b = cut_lineage(bars(spark, sf))
    grid = F.explode(F.array(*[F.lit(x) for x in (-2.5, -1.5, -0.5, 0.0, 0.25, 1.5, 3.0)]))
    requests = b.select("symbol", "date", "time").distinct().select("*", grid.alias("offset"))
    return text_dates(iv_at(iv_surface(b), requests), {"iv": 14})


# The equations of the inner points, solved row by row: forward over the points, then backward.
SURFACE_VALUES_SQL = f"""WITH RECURSIVE {BARS_SQL}, p AS (SELECT symbol, date, time, CAST(strike_offset AS DOUBLE) AS x, min_by(iv, option_type) AS y FROM bars WHERE iv > 0 GROUP BY ALL),
kn AS MATERIALIZED (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, date, time) AS n, lead(x) OVER w - x AS h, (lead(y) OVER w - y)/(lead(x) OVER w - x) AS s,
    x - lag(x) OVER w AS hp, (y - lag(y) OVER w)/(x - lag(x) OVER w) AS sp
  FROM p WINDOW w AS (PARTITION BY symbol, date, time ORDER BY x) QUALIFY count(*) OVER (PARTITION BY symbol, date, time) >= 3),
fw(symbol, date, time, i, cp, dp) AS (
  SELECT symbol, date, time, i, 0.0::DOUBLE, 0.0::DOUBLE FROM kn WHERE i = 0
  UNION ALL SELECT k.symbol, k.date, k.time, k.i, h/(2*(hp+h) - hp*cp), (6*(s-sp) - hp*dp)/(2*(hp+h) - hp*cp)
  FROM fw f JOIN kn k ON k.symbol = f.symbol AND k.date = f.date AND k.time = f.time AND k.i = f.i + 1 AND k.i < k.n - 1),
bw(symbol, date, time, i, m) AS (
  SELECT symbol, date, time, i, 0.0::DOUBLE FROM kn WHERE i = n - 1
  UNION ALL SELECT f.symbol, f.date, f.time, f.i, CASE WHEN f.i = 0 THEN 0 ELSE dp - cp*m END
  FROM bw b JOIN fw f ON f.symbol = b.symbol AND f.date = b.date AND f.time = b.time AND f.i = b.i - 1),
c AS (SELECT k.*, b.m, lead(b.m) OVER w AS m1, lead(y) OVER w AS y1, lead(x) OVER w AS x1, min_by(y, x) OVER e AS ya, max_by(y, x) OVER e AS yz, min(x) OVER e AS xa, max(x) OVER e AS xz
  FROM kn k JOIN bw b USING (symbol, date, time, i) WINDOW w AS (PARTITION BY symbol, date, time ORDER BY x), e AS (PARTITION BY symbol, date, time)),
rq AS (SELECT DISTINCT symbol, date, time, xa, xz, ya, yz, unnest([-2.5::DOUBLE, -1.5, -0.5, 0.0, 0.25, 1.5, 3.0]) AS q FROM c)
SELECT r.symbol, CAST(r.date AS VARCHAR) AS date, r.time, q AS "offset", round(CASE WHEN q <= r.xa THEN r.ya WHEN q >= r.xz THEN r.yz ELSE
  (m*(x1-q)^3 + m1*(q-x)^3)/(6*h) + (y/h - m*h/6)*(x1-q) + (y1/h - m1*h/6)*(q-x) END, 14)+0.0 AS iv
FROM rq r LEFT JOIN c ON c.symbol = r.symbol AND c.date = r.date AND c.time = r.time AND q >= c.x AND q < c.x1"""


DELTA_RUN = [
    strategy("delta", [leg("CE", strike_mode="delta", delta_target=0.4, **sl("delta_breach", 0.8)), leg("PE", strike_mode="delta", delta_target=0.3)]),
]


def delta_selection(spark, sf):
    b, runs, legs = frames(spark, sf, DELTA_RUN)
    t = R.replay(_priced_bars(b), runs, legs).trades
    out = ["run_id", "leg_no", _stamp("entry_ts").alias("entry_at"), _stamp("exit_ts").alias("exit_at"), "held_offset", "exit_reason", "bars_held"]
    return text_dates(t.select(*out, "entry_price", "exit_price", "pnl_gross"), {"pnl_gross": 4})


_DELTA_B = f"""src AS (SELECT *, CAST(7 - day(date) % 7 AS DOUBLE) AS dte FROM bars WHERE iv > 0),
{greeks_sql('src', 'spot', 'strike', 'dte/365.25::DOUBLE', 'iv')},
b AS (SELECT x.*, CAST(CAST(date AS VARCHAR) || ' ' || time AS TIMESTAMP) AS ts, coalesce(g4.delta, 0) AS delta
  FROM bars x LEFT JOIN (SELECT symbol, date, time, option_type, strike_offset, delta FROM g4) g4 USING (symbol, date, time, option_type, strike_offset))"""

DELTA_SQL = replay_sql(DELTA_RUN, EXITS_SELECT, _DELTA_B)


ENTRIES = {
    "F01_rsi_signal": (rsi_signal, RSI_SQL),
    "F02_ema_cross_signal": (ema_cross_signal, EMA_SQL),
    "F03_range_breakout_signal": (range_breakout_signal, RANGE_SQL),
    "F04_supertrend_signal": (supertrend_signal, SUPERTREND_SQL),
    "C12_D32_momentum_gate": (momentum_gate, MOMENTUM_SQL),
    "H03_greeks": (greeks, GREEKS_SQL),
    "H01_H02_option_prices": (option_prices, PRICES_SQL),
    "H04_pnl_attribution": (attribution, ATTRIBUTION_SQL),
    "I08_attribution_summary": (attribution_summary, ATTR_SUMMARY_SQL),
    "H07_iv_surface_points": (surface_points, SURFACE_SQL),
    "H07_iv_at_offsets": (surface_values, SURFACE_VALUES_SQL),
    "C04_D09_delta_legs": (delta_selection, DELTA_SQL),
}

"""Registered queries: metrics and daily series of the derived runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import metrics as M
from ..session import cut_lineage
from .inputs import CAPITAL, SERIES_SQL, TRADE_ORDER, TRADES_SQL, run_table, text_dates, trades

WITH = f"WITH {TRADES_SQL}, {SERIES_SQL}"


# What the metrics read of a trade.
TRADE_COLUMNS = ["run_id", "entry_date", *TRADE_ORDER, "pnl_gross", "pnl_net", "brokerage", "slippage_cost", "stt", "exit_reason",
                 "bars_held", "reentry_attempt"]


def cap():
    return F.lit(CAPITAL)


def _daily(t):
    return M.daily_equity_from_trades(t, cap())


def _series(t):
    return M.daily_series(_daily(t), capital=cap())


def trade_metrics(spark, sf):
    return text_dates(M.trade_metrics(trades(spark, sf)))


TRADE_METRICS_SQL = f"""
WITH {TRADES_SQL}, a AS (
  SELECT run_id, count(*) AS n, sum(pnl_gross) AS g, sum(pnl_net) AS p, sum(brokerage) AS b,
    sum(slippage_cost) AS s, sum(stt) AS t, count(*) FILTER (pnl_net > 0) AS wins,
    coalesce(avg(pnl_net) FILTER (pnl_net > 0), 0) AS aw, coalesce(avg(pnl_net) FILTER (pnl_net <= 0), 0) AS al,
    greatest(max(pnl_net), 0) AS lw, least(min(pnl_net), 0) AS ll,
    coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) AS gp, coalesce(-sum(pnl_net) FILTER (pnl_net <= 0), 0) AS gl,
    avg(bars_held) AS ah, max(bars_held) AS mh,
    count(*) FILTER (exit_reason = 'stop_loss') AS sl, count(*) FILTER (exit_reason = 'target') AS tg,
    count(*) FILTER (exit_reason = 'time_exit') AS te, count(*) FILTER (reentry_attempt > 0) AS re,
    count(*) FILTER (reentry_attempt > 0 AND pnl_net > 0) AS rw
  FROM trades GROUP BY run_id)
SELECT CAST(run_id AS BIGINT) AS run_id, n AS total_trades, g AS total_pnl_gross, p AS total_pnl_net, b AS total_brokerage,
  s AS total_slippage, t AS total_stt_cost, round(p/n,6) AS expectancy, round(wins/n*100.0,6) AS win_rate_pct,
  round(aw,6) AS avg_win, round(al,6) AS avg_loss, lw AS largest_win, ll AS largest_loss,
  gp AS gross_profit, gl AS gross_loss, CASE WHEN gl > 0 THEN round(gp/gl,6) END AS profit_factor,
  CASE WHEN al <> 0 THEN round(aw/abs(al),6) END AS win_loss_ratio, round(ah,6) AS avg_hold_bars,
  CAST(mh AS BIGINT) AS max_hold_bars, round(sl/n*100.0,6) AS sl_hit_rate_pct, round(tg/n*100.0,6) AS target_hit_rate_pct,
  round(te/n*100.0,6) AS time_exit_rate_pct, re AS reentry_count,
  round(CASE WHEN re > 0 THEN rw*100.0/re ELSE 0 END,6) AS reentry_win_rate,
  round(CASE WHEN g <> 0 THEN b*100.0/abs(g) ELSE 0 END,6) AS net_cost_ratio
FROM a"""


def daily_series(spark, sf):
    return text_dates(_series(trades(spark, sf)), {"daily_return": 10, "drawdown_pct": 11})


DAILY_SERIES_SQL = f"""{WITH}
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(date AS VARCHAR) AS date, equity, prev_equity, peak, daily_pnl,
  round(daily_return,10) + 0.0 AS daily_return, drawdown, round(drawdown_pct,11) + 0.0 AS drawdown_pct FROM series"""


def risk_metrics(spark, sf):
    return text_dates(M.risk_metrics(_series(trades(spark, sf))), {"daily_volatility": 9, "ann_volatility": 8})


_RISK_CTES = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY daily_pnl NULLS LAST, date) AS rk,
             count(daily_pnl) OVER (PARTITION BY run_id) AS npnl,
             sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY date) AS isl FROM series),
vars AS (SELECT run_id, max(daily_pnl) FILTER (rk = least(floor(0.05::DOUBLE*npnl), npnl-1)+1) AS v95,
             max(daily_pnl) FILTER (rk = least(floor(0.01::DOUBLE*npnl), npnl-1)+1) AS v99 FROM ranked GROUP BY run_id),
under AS (SELECT run_id, max(d) AS dd_days FROM (
             SELECT run_id, isl, count(*) FILTER (equity < peak) AS d FROM ranked GROUP BY run_id, isl) GROUP BY run_id),
m0 AS (SELECT run_id, avg(daily_return) AS mu, count(daily_return) AS n, stddev_samp(daily_return) AS sd FROM series GROUP BY run_id),
risk AS (
  SELECT s.run_id, count(*) AS trading_days, max(drawdown) AS mdd,
    max_by(drawdown_pct, struct_pack(a := drawdown, b := -date_diff('day', DATE '1970-01-01', date))) AS mddp,
    avg(drawdown) FILTER (drawdown > 0) AS addn, sqrt(avg(drawdown_pct*drawdown_pct)) AS ulcer,
    max(m0.mu) AS mu, max(m0.n) AS n, max(m0.sd) AS sd,
    avg((daily_return-0.065::DOUBLE/252)*(daily_return-0.065::DOUBLE/252)) FILTER (daily_return < 0.065::DOUBLE/252) AS down2,
    sum(daily_return) FILTER (daily_return > 0) AS gain, -sum(daily_return) FILTER (daily_return <= 0) AS pain,
    avg(power((daily_return-m0.mu)/m0.sd,3)) AS skew, avg(power((daily_return-m0.mu)/m0.sd,4))-3 AS kurt,
    max(v95) AS v95, max(v99) AS v99, avg(daily_pnl) FILTER (daily_pnl <= v95) AS cvar, max(dd_days) AS dd_days
  FROM series s JOIN m0 USING (run_id) JOIN vars USING (run_id) JOIN under USING (run_id) GROUP BY s.run_id)"""

RISK_METRICS_SQL = f"""{WITH}, {_RISK_CTES}
SELECT CAST(run_id AS BIGINT) AS run_id, trading_days, mdd AS max_drawdown_inr, round(mddp,6) AS max_drawdown_pct,
  round(coalesce(addn,0),6) AS avg_drawdown, round(ulcer,6) AS ulcer_index, CAST(dd_days AS BIGINT) AS drawdown_duration_days,
  round(sd,9) AS daily_volatility, round(sd*sqrt(252.0),8) AS ann_volatility,
  round((mu-0.065::DOUBLE/252)/sd*sqrt(252.0),6) AS sharpe_ratio, round((mu-0.065::DOUBLE/252)/sqrt(down2)*sqrt(252.0),6) AS sortino_ratio,
  round(gain/pain,6) AS omega_ratio, round(skew,6) AS skewness, round(kurt,6) AS kurtosis,
  v95 AS var_95, v99 AS var_99, round(cvar,6) AS cvar FROM risk"""


def trade_streaks(spark, sf):
    return text_dates(M.trade_streaks(trades(spark, sf), TRADE_ORDER))


TRADE_STREAKS_SQL = f"""
WITH {TRADES_SQL}, f AS (SELECT run_id, trade_id, pnl_net > 0 AS win,
    trade_id - row_number() OVER (PARTITION BY run_id, pnl_net > 0 ORDER BY trade_id) AS isl FROM trades),
g AS (SELECT run_id, win, isl, count(*) AS c FROM f GROUP BY ALL)
SELECT CAST(run_id AS BIGINT) AS run_id, coalesce(max(c) FILTER (win),0) AS max_consec_wins,
  coalesce(max(c) FILTER (NOT win),0) AS max_consec_losses FROM g GROUP BY run_id"""


def run_metrics(spark, sf):
    t = cut_lineage(trades(spark, sf).select(*TRADE_COLUMNS))
    wide = M.run_metrics(t, _daily(t), run_table(t), TRADE_ORDER)
    return text_dates(wide, {"daily_volatility": 9, "ann_volatility": 8})


RUN_METRICS_SQL = f"""{WITH}, {_RISK_CTES},
tm AS ({TRADE_METRICS_SQL.replace('WITH ' + TRADES_SQL + ', a AS', 'WITH a AS')}),
st AS ({TRADE_STREAKS_SQL.replace('WITH ' + TRADES_SQL + ', f AS', 'WITH f AS')}),
span AS (SELECT run_id, greatest(date_diff('day', min(entry_date), max(exit_date)),1)/365.25::DOUBLE AS years FROM trades GROUP BY run_id),
w AS (SELECT *, power((5.0e11::DOUBLE+total_pnl_net)/5.0e11::DOUBLE, 1/years)-1 AS cg
      FROM tm JOIN risk USING (run_id) JOIN st USING (run_id) JOIN span USING (run_id))
SELECT run_id, total_trades, total_pnl_gross, total_pnl_net, total_brokerage, total_slippage, total_stt_cost,
  round(total_pnl_net/5.0e11::DOUBLE*100,6) AS roi_pct, expectancy, win_rate_pct, avg_win, avg_loss, largest_win, largest_loss,
  gross_profit, gross_loss, profit_factor, win_loss_ratio, round(cg,6) AS cagr, avg_hold_bars, max_hold_bars,
  sl_hit_rate_pct, target_hit_rate_pct, time_exit_rate_pct, reentry_count, reentry_win_rate, net_cost_ratio,
  mdd AS max_drawdown_inr, round(mddp,6) AS max_drawdown_pct, round(coalesce(addn,0),6) AS avg_drawdown,
  round((mu-0.065::DOUBLE/252)/sd*sqrt(252.0),6) AS sharpe_ratio, round((mu-0.065::DOUBLE/252)/sqrt(down2)*sqrt(252.0),6) AS sortino_ratio,
  round(CASE WHEN mddp > 0 THEN cg/(mddp/100) ELSE 0 END,6) AS calmar_ratio, round(gain/pain,6) AS omega_ratio,
  v95 AS var_95, v99 AS var_99, round(cvar,6) AS cvar, round(ulcer,6) AS ulcer_index,
  round(sd,9) AS daily_volatility, round(sd*sqrt(252.0),8) AS ann_volatility, round(skew,6) AS skewness, round(kurt,6) AS kurtosis,
  round(CASE WHEN mdd > 0 THEN total_pnl_net/mdd ELSE 0 END,6) AS recovery_factor, CAST(dd_days AS BIGINT) AS drawdown_duration_days,
  max_consec_wins, max_consec_losses FROM w"""

ENTRIES = {
    "E01_E05_E07_E10_trade_metrics": (trade_metrics, TRADE_METRICS_SQL),
    "F05_F06_F08_daily_series": (daily_series, DAILY_SERIES_SQL),
    "E11_E24_risk_metrics": (risk_metrics, RISK_METRICS_SQL),
    "E25_F10_trade_streaks": (trade_streaks, TRADE_STREAKS_SQL),
    "E_run_metrics": (run_metrics, RUN_METRICS_SQL),
}

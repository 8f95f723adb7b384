"""Strategies over bars: entries, marks, first exits, trades and equity, as joins and windows.

A position is not simulated bar by bar. All bars of every held contract, from entry to the
latest possible exit, are joined at once; stop and target conditions become flags on those
rows; the exit is the first flagged bar. Rows move through one shuffle on (run, entry), which
is never larger than one position's life.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs
from ..functions.clock import bar_ts
from ..operators.asof import expiry_gate, lot_size_asof, with_expiry_dates
from ..operators.contracts import bar_spine, entry_candidates, horizons, select_contract, series_of, with_ordinals
from ..operators.ordered import block_scan
from ..session import cut_lineage
from . import hits

KEY = ["run_id", "entry_ts"]


def c(name: str) -> Column:
    return F.col(name)


def sl_hit(kind: Column, value: Column, entry: Column, worst: Column, spot: Column, entry_spot: Column, sign: Column, delta: Column | None = None) -> Column:
    """Fixed stop of one leg at its worst price (index and delta stops use the close)."""
    pnl = (worst - entry) * sign
    pct = F.when(entry > 0, -pnl / F.when(entry > 0, entry) * 100).otherwise(0.0)
    margin = F.greatest(entry * 3.0, entry_spot * 0.12)
    of_margin = F.when(margin > 0, -pnl / F.when(margin > 0, margin) * 100).otherwise(0.0)
    hit = (
        F.when(kind == "points", -pnl >= value)
        .when(kind == "percent_of_premium", pct >= value)
        .when(kind == "percent_of_margin", of_margin >= value)
        .when(kind == "index_points", (spot - entry_spot) * -sign >= value)
    )
    if delta is not None:
        hit = hit.when(kind == "delta_breach", (delta != 0) & (F.abs(delta) >= value))
    return F.coalesce(hit.otherwise(False), F.lit(False))


def target_hit(kind: Column, value: Column, entry: Column, best: Column, sign: Column) -> Column:
    gain = (best - entry) * sign
    pct = F.when(entry > 0, gain / F.when(entry > 0, entry) * 100).otherwise(0.0)
    hit = F.when(kind == "percent_of_premium", pct >= value).when(kind == "points", gain >= value)
    return F.coalesce(hit.otherwise(False), F.lit(False))


def overall_hit(kind: Column, value: Column, amount: Column, premium: Column, rupee_kinds: list[str]) -> Column:
    """Position-level stop (``amount`` = loss) or target (``amount`` = gain)."""
    pct = F.when(premium > 0, amount / F.when(premium > 0, premium) * 100).otherwise(0.0)
    hit = F.when(kind == "percent_of_premium", pct >= value).when(kind.isin(rupee_kinds), amount >= value)
    return F.coalesce(hit.otherwise(False), F.lit(False))


def open_legs(wanted: DataFrame, runs: DataFrame, legs: DataFrame, bars: DataFrame, lot_rules: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Opened legs with slipped entry price and quantity; ``entry_ts`` identifies the position."""
    chosen = select_contract(wanted, legs, bars, times)
    terms = legs.drop("option_type", "strike_offset", "expiry", "strike_mode", "delta_target", "premium_target")
    opened = chosen.join(terms, ["run_id", "leg_no"]).join(runs.drop("symbol", "name"), "run_id")
    if lot_rules is not None:
        opened = lot_size_asof(opened, lot_rules, date="date", out="_rule_lot")
        opened = opened.withColumn("lot_size", F.coalesce("lot_size", "_rule_lot")).drop("_rule_lot")
    opened = opened.withColumn("lot_size", F.coalesce("lot_size", F.lit(1)))
    return (
        opened.withColumn("quantity", (c("lots") * c("lot_size")).cast("double"))
        .withColumn("entry_price", costs.slippage(c("raw_price"), c("position"), c("slippage_model"), c("slippage_value")))
        .withColumn("sign", costs.direction(c("position")))
        .withColumnsRenamed({"ts": "entry_ts", "date": "entry_date", "time": "entry_clock"})
    )


# Leg terms that the mark rows still need once the fixed stop and target are flags.
_TRAIL = ["trail_sl_enabled", "trail_sl_activate_at", "trail_sl_lock_in", "trail_sl_mode", "trail_sl_unit", "trail_sl_value"]
_OVERALL = ["overall_sl_enabled", "overall_sl_type", "overall_sl_value", "overall_target_enabled", "overall_target_type", "overall_target_value"]


def with_horizon(positions: DataFrame, spine_horizons: DataFrame) -> DataFrame:
    """Add the latest exit; a position opened at or past its exit time closes on that bar."""
    h = spine_horizons.withColumnRenamed("date", "entry_date")
    late = c("entry_ts").cast("string").substr(12, 8) >= c("exit_time")
    return (
        positions.join(h, ["symbol", "exit_time", "entry_date"])
        .withColumn("horizon_ts", F.when(late, c("entry_ts")).otherwise(c("horizon_ts")))
        .withColumn("eod", c("eod") & ~late)
    )


def held_bars(opened: DataFrame, bars: DataFrame, track_by: str = "offset") -> DataFrame:
    """Every bar of each held contract from entry to horizon, with its worst and best price for the leg.

    ``opened`` carries its horizon (:func:`with_horizon`). The interval is turned into its days, so
    the join with bars is an equality on (symbol, date, option type, contract, expiry); only the ends
    need the time comparison.
    """
    held = opened.withColumn("date", F.explode(F.sequence("entry_date", c("horizon_ts").cast("date"))))
    contract = {"offset": ("held_offset", "strike_offset"), "strike": ("held_strike", "strike")}[track_by]
    prices = bars.select(
        "symbol",
        "date",
        c("time").alias("time"),
        "option_type",
        c(contract[1]).alias(contract[0]),
        series_of(bars).alias("held_series"),
        c("close"),
        c("high"),
        c("low"),
        c("spot"),
        (c("delta") if "delta" in bars.columns else F.lit(None).cast("double")).alias("delta"),
    ).withColumn("ts", bar_ts())
    m = held.join(prices, ["symbol", "date", "option_type", contract[0], "held_series"]).where(
        c("ts").between(c("entry_ts"), c("horizon_ts"))
    )
    # The entry bar is close-only: the position did not exist during its range.
    first = c("ts") == c("entry_ts")
    hi = F.when(first, c("close")).otherwise(F.greatest("high", "close"))
    lo = F.when(first, c("close")).otherwise(F.least("low", "close"))
    short = c("position") == "sell"
    return m.withColumn("worst", F.when(short, hi).otherwise(lo)).withColumn("best", F.when(short, lo).otherwise(hi))


def mark_positions(opened: DataFrame, bars: DataFrame, track_by: str = "offset") -> DataFrame:
    """:func:`held_bars` of opened legs, with stop and target flags."""
    m = held_bars(opened, bars, track_by)
    sl = c("stop_loss_enabled") & sl_hit(
        c("stop_loss_type"), c("stop_loss_value"), c("entry_price"), c("worst"), c("spot"), c("entry_spot"), c("sign"), c("delta")
    )
    tg = c("target_profit_enabled") & target_hit(
        c("target_profit_type"), c("target_profit_value"), c("entry_price"), c("best"), c("sign")
    )
    return m.select(
        *KEY, "leg_no", "ts", "close", "worst", "best", "spot",
        ((c("close") - c("entry_price")) * c("sign") * c("quantity")).alias("pnl"),
        (c("entry_price") * c("quantity")).alias("premium"),
        c("quantity").alias("quantity"),
        sl.alias("sl"), tg.alias("tg"),
        *_TRAIL, *_OVERALL, "exit_time", "horizon_ts", "eod",
    )


def _horizon_rows(opened: DataFrame) -> DataFrame:
    """One row per position at its horizon, where it closes even if no leg has a bar."""
    pos = opened.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("leg_no")).alias("leg_nos"),
        *[F.first(o).alias(o) for o in [*_OVERALL, "exit_time", "horizon_ts", "eod"]],
    )
    return pos.select(
        *KEY, c("horizon_ts").alias("ts"), "leg_nos", *_OVERALL, "exit_time", "horizon_ts", "eod"
    )


def exit_flags(marks: DataFrame, horizon_rows: DataFrame) -> DataFrame:
    """One row per (position, bar): leg states carried over missing bars, sums, exit reason."""
    rows = marks.unionByName(horizon_rows, allowMissingColumns=True).repartition(*KEY)
    leg = Window.partitionBy(*KEY, "leg_no").orderBy("ts")
    sofar = leg.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bars_held", F.row_number().over(leg))
    # Trailing stop: high-water mark since activation; it can fire only after activation.
    pct = F.when(c("premium") > 0, c("pnl") / F.when(c("premium") > 0, c("premium")) * 100).otherwise(0.0)
    ready = c("trail_sl_enabled") & (pct >= c("trail_sl_activate_at"))
    rows = rows.withColumn("act_ts", F.min(F.when(ready, c("ts"))).over(sofar))
    rows = rows.withColumn("high_water", F.max(F.when(c("act_ts").isNotNull(), c("pnl"))).over(sofar))
    gap = F.when(c("trail_sl_unit") == "points", c("trail_sl_value") * c("quantity")).otherwise(
        c("high_water") * (c("trail_sl_value") / 100)
    )
    trailed = F.when(
        c("trail_sl_mode") == "lock", c("pnl") < c("high_water") * (c("trail_sl_lock_in") / 100)
    ).otherwise((c("high_water") - c("pnl") >= gap) & (gap > 0))
    rows = rows.withColumn("sl", F.coalesce((c("ts") > c("act_ts")) & trailed, F.lit(False)) | F.coalesce(c("sl"), F.lit(False)))

    state = F.struct("leg_no", "close", "worst", "best", "spot", "pnl", "premium", "bars_held")
    at = rows.groupBy(*KEY, "ts").agg(
        F.collect_list(F.when(c("leg_no").isNotNull(), state)).alias("present"),
        F.max(F.coalesce(c("sl"), F.lit(False))).alias("leg_sl"),
        F.max(F.coalesce(c("tg"), F.lit(False))).alias("leg_tg"),
        F.max("leg_nos").alias("leg_nos"),
        *[F.first(o).alias(o) for o in [*_OVERALL, "exit_time", "horizon_ts", "eod"]],
    )
    whole = Window.partitionBy(*KEY)
    at = at.withColumn("leg_nos", F.max("leg_nos").over(whole))
    one = F.explode("leg_nos").alias("leg_no")
    grid = at.select("*", one).withColumn(
        "_now", F.try_element_at(F.filter("present", lambda p: p["leg_no"] == c("leg_no")), F.lit(1))
    )
    grid = grid.withColumn("_state", F.last("_now", ignorenulls=True).over(sofar))
    pos = grid.groupBy(*KEY, "ts").agg(
        F.array_sort(F.collect_list("_state")).alias("states"),
        *[F.first(o).alias(o) for o in ["leg_sl", "leg_tg", *_OVERALL, "exit_time", "horizon_ts", "eod"]],
    )
    pos = pos.withColumn("unrealized", F.aggregate("states", F.lit(0.0), lambda a, s: a + s["pnl"]))
    pos = pos.withColumn("premium", F.aggregate("states", F.lit(0.0), lambda a, s: a + s["premium"]))
    o_sl = c("overall_sl_enabled") & overall_hit(
        c("overall_sl_type"), c("overall_sl_value"), -c("unrealized"), c("premium"), ["combined_premium", "points"]
    )
    o_tg = c("overall_target_enabled") & overall_hit(
        c("overall_target_type"), c("overall_target_value"), c("unrealized"), c("premium"), ["points"]
    )
    reason = (
        F.when(c("leg_sl"), "stop_loss")
        .when(o_sl, "combined_sl")
        .when(c("leg_tg"), "target")
        .when(o_tg, "combined_target")
        .when((c("ts") == c("horizon_ts")) & c("eod"), "end_of_data")
        .when(c("ts") == c("horizon_ts"), "time_exit")
    )
    return pos.select(*KEY, "ts", "unrealized", "states", reason.alias("reason"))


def first_exit(flags: DataFrame) -> DataFrame:
    """Keep each position's bars up to its first flagged bar; leg states only on that bar."""
    whole = Window.partitionBy(*KEY)
    f = flags.withColumn("exit_ts", F.min(F.when(c("reason").isNotNull(), c("ts"))).over(whole))
    f = f.where(c("ts") <= c("exit_ts"))
    closing = c("ts") == c("exit_ts")
    return f.select(
        *KEY, "ts", "exit_ts", "unrealized",
        F.when(closing, c("reason")).alias("reason"),
        F.when(closing, c("states")).alias("states"),
    )


#: What the choice of positions needs of each: when it blocks others from, and when it ends.
EXIT = ["run_id", "entry_ts", "exit_ts", "reason", "start_ts", "forced", "attempt"]


def non_overlapping(exits: DataFrame) -> DataFrame:
    """Positions a run really takes (run_id, entry_ts, forced): one at a time, the next strictly after the last exit.

    Re-entries (``forced``) are taken and block later regular entries from the exit that armed them
    (``start_ts``). A position that starts after all earlier ones have ended is taken whatever
    becomes of them. Where positions overlap, each is linked to the first that starts after its
    exit, and what is taken is what links reach from those: pointers double in each round,
    so a chain of n positions takes log n rounds of joins and no run is gathered anywhere.
    """
    order = Window.partitionBy("run_id").orderBy("start_ts", "forced", "entry_ts")
    busy = F.max("exit_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = exits.select("run_id", "entry_ts", "exit_ts", "start_ts", "forced").withColumn("_busy", busy)
    free = c("forced") | c("_busy").isNull() | (c("start_ts") > c("_busy"))
    rows = cut_lineage(rows.withColumn("free", free).withColumn("id", F.monotonically_increasing_id()).drop("_busy"))
    out = ["run_id", "entry_ts", "forced"]
    crowded = rows.where(~c("free")).select("run_id").distinct()
    if crowded.isEmpty():
        return rows.select(*out)
    some = rows.join(crowded, "run_id", "left_semi")
    nothing = F.lit(None)
    starts = some.select(
        "run_id", c("start_ts").alias("ts"), c("forced").cast("int").alias("forced"), F.lit(0).alias("asks"),
        F.struct("id", "free").alias("to"), nothing.cast("bigint").alias("id"),
    )
    ends = some.select("run_id", c("exit_ts").alias("ts"), F.lit(0).alias("forced"), F.lit(1).alias("asks"), nothing.cast("struct<id: bigint, free: boolean>").alias("to"), "id")
    # Backward in time; on the exit's own bar a re-entry follows it, a regular entry does not.
    back = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("forced"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    links = starts.unionByName(ends).withColumn("next", F.last("to", ignorenulls=True).over(back))
    jumps = cut_lineage(links.where((c("asks") == 1) & ~c("next.free")).select("id", c("next.id").alias("to")))
    taken = cut_lineage(some.where("free").select("id"))
    while True:
        more = jumps.join(taken, "id", "left_semi").select(c("to").alias("id")).distinct()
        more = cut_lineage(more.join(taken, "id", "left_anti"))
        if more.isEmpty():
            break
        taken = taken.unionByName(more)
        jumps = cut_lineage(jumps.join(jumps.select(c("id").alias("to"), c("to").alias("further")), "to").select("id", c("further").alias("to")))
    return rows.where("free").unionByName(rows.where(~c("free")).join(taken, "id", "left_semi")).select(*out)


def closed_trades(opened: DataFrame, exits: DataFrame) -> DataFrame:
    """Trades per leg from the opened legs and their positions' exit bars (with states)."""
    legs = exits.select(*KEY, "exit_ts", "reason", "attempt", F.explode("states").alias("_s")).select(
        *KEY, "exit_ts", "reason", "attempt",
        c("_s.leg_no").alias("leg_no"), c("_s.close").alias("_close"), c("_s.worst").alias("_worst"),
        c("_s.best").alias("_best"), c("_s.spot").alias("exit_spot"), c("_s.bars_held").alias("bars_held"),
    )
    t = opened.join(legs, [*KEY, "leg_no"])
    wick = c("stop_loss_type").isin("points", "percent_of_premium", "percent_of_margin")
    raw = (
        F.when((c("reason") == "stop_loss") & wick, c("_worst"))
        .when(c("reason") == "target", c("_best"))
        .otherwise(c("_close"))
    )
    model, val, side, qty = c("slippage_model"), c("slippage_value"), c("position"), c("quantity")
    t = t.withColumn("raw_exit", raw)
    t = t.withColumn("exit_price", costs.slippage(c("raw_exit"), costs.opposite(side), model, val))
    t = t.withColumn("brokerage", costs.brokerage(c("brokerage_per_lot"), c("lots")))
    sold_at = F.when(side == "sell", c("entry_price")).otherwise(c("exit_price"))
    t = t.withColumn("stt", costs.stt(sold_at, qty, c("stt_on_sell")))
    t = t.withColumn("slippage_cost", costs.slippage_cost(c("entry_price"), c("raw_exit"), model, val, qty))
    t = t.withColumn("other_charges", costs.charges(c("entry_price"), c("exit_price"), qty, c("brokerage"), side))
    t = t.withColumn("pnl_gross", (c("exit_price") - c("entry_price")) * c("sign") * qty)
    t = t.withColumn("pnl_net", c("pnl_gross") - c("brokerage") - c("stt") - c("other_charges"))
    return t.select(
        "run_id", "symbol", "leg_no",
        "entry_date", c("entry_clock").alias("entry_time"), "entry_ts",
        c("exit_ts").cast("date").alias("exit_date"),
        F.substring(c("exit_ts").cast("string"), 12, 8).alias("exit_time"), "exit_ts",
        "option_type", "held_offset", c("position").alias("position_side"),
        "entry_price", "exit_price", "entry_spot", "exit_spot", "lots", "lot_size",
        "pnl_gross", "pnl_net", "brokerage", "stt", "slippage_cost", "other_charges",
        c("reason").alias("exit_reason"), c("bars_held").cast("int").alias("bars_held"),
        c("attempt").cast("int").alias("reentry_attempt"),
    )


TRADE_ORDER = ["exit_ts", "entry_ts", "leg_no"]


@dataclass
class Replay:
    """Results of one replay. ``marks`` holds the bars of the positions taken."""

    trades: DataFrame
    marks: DataFrame
    spine: DataFrame
    runs: DataFrame
    entries: DataFrame
    thin: bool = False

    def equity(self) -> DataFrame:
        if self.thin:
            raise ValueError("a thin replay has no bar-grain equity")
        return equity_snapshots(self.spine, self.runs, self.marks, self.trades)

    def daily_equity(self) -> DataFrame:
        return daily_equity_of(self.spine, self.runs, self.marks, self.trades)


def _evaluate(wanted, runs, legs, bars, hz, lot_rules, track_by, trailing, thin, times=None):
    """Opened legs and the positions' bars. A trailing stop follows its own path through the bars;
    all other positions look their exits up in the index."""
    opened = cut_lineage(with_horizon(open_legs(wanted, runs, legs, bars, lot_rules, times), hz))
    priced, parts = bars.hint("merge") if thin else bars, []
    if trailing is not None:
        followed = opened.join(trailing, "run_id", "left_semi")
        parts.append(first_exit(exit_flags(mark_positions(followed, priced, track_by), _horizon_rows(followed))))
    if trailing is None or not legs.join(trailing, "run_id", "left_anti").isEmpty():
        looked = opened if trailing is None else opened.join(trailing, "run_id", "left_anti")
        positions = cut_lineage(hits.positions_of(looked))
        frames = cut_lineage(hits.index_frames(positions, lambda held, by: held_bars(held, priced, by), track_by))
        parts.append(hits.exits(positions, frames, overall_hit, thin))
    pos = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True).select(*parts[0].columns)
    return opened, pos


def replay(
    bars: DataFrame,
    runs: DataFrame,
    legs: DataFrame,
    signals: DataFrame | None = None,
    lot_rules: DataFrame | None = None,
    expiry_rules: DataFrame | None = None,
    entry_filter: DataFrame | None = None,
    track_by: str = "offset",
    thin: bool = False,
) -> Replay:
    """Trades and equity of all runs in one plan.

    ``thin`` keeps only the bars that trades and daily equity need; bar-grain equity then has none. It is for sweeps:
    their positions repeat so much that the stored files are a small part of the rows. By the files' size Spark would
    gather them on the driver to broadcast them, so bars and positions ask for merge joins.

    ``signals`` (symbol, date, time, signal) confirm momentum re-entries; ``entry_filter``
    (run_id, date, time) keeps only those regular entries; ``expiry_rules`` enforce
    trade_on_expiry. Where bars name their expiry type, a leg trades its ``expiry`` or, if it names
    none, its run's ``expiry_filter``; with ``expiry_rules`` a position keeps to the expiry date it
    was opened for, and has no bars after it. What several later steps read is written once: the spine, the opened
    legs, and the narrow position bars (for the trades, the one-at-a-time rule and equity).
    """
    from .reentry import with_reentries

    if "expiry_type" in bars.columns:
        filters = runs.select("run_id", c("expiry_filter").alias("_filter"))
        legs = legs.join(filters, "run_id").withColumn("expiry", F.coalesce("expiry", "_filter")).select(*legs.columns)
        if expiry_rules is not None and "expiry_date" not in bars.columns:
            bars = cut_lineage(with_expiry_dates(bars, expiry_rules))
    spine = cut_lineage(bar_spine(bars))
    hz = horizons(spine, runs)
    wanted = entry_candidates(spine, runs)
    if entry_filter is not None:
        wanted = wanted.join(entry_filter.select("run_id", "date", "time").distinct(), ["run_id", "date", "time"], "left_semi")
    if expiry_rules is not None:
        wanted = expiry_gate(wanted, runs, expiry_rules)
    times = runs.select(c("entry_time").alias("time"))
    trailing = legs.where("trail_sl_enabled").select("run_id").distinct()
    trailing = None if trailing.isEmpty() else cut_lineage(trailing)
    opened, pos = _evaluate(wanted, runs, legs, bars, hz, lot_rules, track_by, trailing, thin, times)
    pos = cut_lineage(pos.withColumn("start_ts", c("entry_ts")).withColumn("forced", F.lit(False)).withColumn("attempt", F.lit(0)))

    exits = pos.where(c("reason").isNotNull()).select(*EXIT)
    if not legs.where("(reentry_on_sl OR reentry_on_target) AND reentry_max_attempts > 0").isEmpty():
        kept_hz = cut_lineage(hz)

        def evaluate(wanted, days_bars):
            return _evaluate(wanted, runs, legs, days_bars, kept_hz, lot_rules, track_by, trailing, thin)

        opened, pos, exits = with_reentries(opened, pos, runs, legs, bars, with_ordinals(spine), signals, kept_hz, evaluate)

    taken = non_overlapping(exits)
    if thin:
        opened, taken = opened.hint("merge"), taken.hint("merge")
    pos = pos.join(taken, [*KEY, "forced"], "left_semi")
    trades = closed_trades(opened, pos.where(c("reason").isNotNull()))
    return Replay(trades, pos, spine, runs, opened, thin)


def _run_spine(spine: DataFrame, runs: DataFrame) -> DataFrame:
    return spine.join(runs.select("run_id", "symbol", "capital"), "symbol")


def _realized(trades: DataFrame) -> DataFrame:
    # The close forced by the end of the data comes after the last snapshot.
    booked = trades.where(c("exit_reason") != "end_of_data")
    return booked.groupBy("run_id", c("exit_ts").alias("ts")).agg(F.sum("pnl_net").alias("booked"))


def equity_snapshots(spine: DataFrame, runs: DataFrame, marks: DataFrame, trades: DataFrame) -> DataFrame:
    """Equity at every bar time of every run: capital, realised so far, and open P&L."""
    done = (c("ts") == c("exit_ts")) & (c("reason") != "end_of_data")
    # An entry may follow on the bar after an exit, never on the same bar.
    open_pnl = marks.groupBy("run_id", "ts").agg(
        F.max_by(F.when(F.coalesce(done, F.lit(False)), 0.0).otherwise(c("unrealized")), c("entry_ts")).alias("_open")
    )
    s = _run_spine(spine, runs).join(open_pnl, ["run_id", "ts"], "left").join(_realized(trades), ["run_id", "ts"], "left")
    s = block_scan(s, ["run_id"], ["date"], ["ts"], unrealized_pnl=("last", c("_open")), cumulative_pnl=("sum", c("booked")))
    s = s.withColumn("unrealized_pnl", F.coalesce("unrealized_pnl", F.lit(0.0)))
    return s.select(
        "run_id", "symbol", "date", "time", "ts", "spot", "unrealized_pnl",
        c("cumulative_pnl").cast("double").alias("cumulative_pnl"),
        (c("capital") + c("cumulative_pnl") + c("unrealized_pnl")).alias("equity"),
    )


def daily_equity_of(spine: DataFrame, runs: DataFrame, marks: DataFrame, trades: DataFrame) -> DataFrame:
    """Closing equity per run and day, without building the bar-grain curve.

    Equals ``daily_equity(equity_snapshots(...))``: realised P&L by day, plus the last open
    mark of a position that stays open overnight.
    """
    days = spine.groupBy("symbol", "date").agg(F.lit(1).alias("_d")).drop("_d")
    d = days.join(runs.select("run_id", "symbol", "capital"), "symbol")
    booked = _realized(trades).groupBy("run_id", c("ts").cast("date").alias("date")).agg(F.sum("booked").alias("_b"))
    done = (c("ts") == c("exit_ts")) & (c("reason") != "end_of_data")
    last = marks.groupBy("run_id", c("ts").cast("date").alias("date")).agg(
        F.max_by(
            F.when(F.coalesce(done, F.lit(False)), 0.0).otherwise(c("unrealized")), F.struct("ts", "entry_ts")
        ).alias("_o")
    )
    w = Window.partitionBy("run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(booked, ["run_id", "date"], "left").join(last, ["run_id", "date"], "left")
    total = c("capital") + F.coalesce(F.sum("_b").over(w), F.lit(0.0)) + F.coalesce(F.last("_o", ignorenulls=True).over(w), F.lit(0.0))
    return d.select("run_id", "symbol", "date", total.alias("equity"))

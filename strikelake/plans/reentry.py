"""Re-entries: one state machine a leg, all runs at once, one pass an event.

An event is the first exit of a run that arms one of its legs' trackers (or finds one still
armed); it ends with the bar on which the run opens again. Trackers are rows: idle, cooling with
bars left, or waiting for a signal, and how many re-entries the leg has counted. A pass looks at
narrow tables only and appends the new positions' bars; nothing written before is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bar_ts
from ..operators.contracts import expiry_of
from ..operators.ordered import block_scan
from ..session import cut_lineage

FAR = "9999-12-31"
IDLE, COOLING, WAITING = "idle", "cooling", "waiting"


def trackers(legs: DataFrame) -> DataFrame:
    """A tracker for each leg that may re-enter; ``since`` is the run's last re-entry."""
    return legs.where("reentry_on_sl OR reentry_on_target").select(
        "run_id", "leg_no", "position", "reentry_on_sl", "reentry_on_target", "reentry_mode",
        "reentry_cooldown_bars", "reentry_max_attempts",
        F.lit(IDLE).alias("state"), F.lit(0).cast("bigint").alias("left"), F.lit(0).alias("done"),
        F.lit(None).cast("timestamp_ntz").alias("since"),
    )


def armed_trackers(taken: DataFrame, tracked: DataFrame) -> DataFrame:
    """The trackers that a run's next event arms or finds armed, with ``armed_ts``, its bar.

    Stops arm idle legs with reentry_on_sl, targets those with reentry_on_target, as long as the leg
    has attempts left; time exits and the end of the data arm nothing. A leg that another leg's
    re-entry left cooling or waiting goes on with it after the next exit, whatever that exit was.
    """
    c = F.col
    stop = c("reason").isin("stop_loss", "combined_sl")
    target = c("reason").isin("target", "combined_target")
    arms = ((stop & c("reentry_on_sl")) | (target & c("reentry_on_target"))) & (c("done") < c("reentry_max_attempts"))
    met = (
        taken.select("run_id", "entry_ts", "exit_ts", "reason")
        .join(tracked, "run_id")
        .where((c("since").isNull() | (c("entry_ts") >= c("since"))) & ((c("state") != IDLE) | arms))
    )
    met = met.withColumn("_first", F.min("exit_ts").over(Window.partitionBy("run_id"))).where(c("exit_ts") == c("_first"))
    return met.withColumnRenamed("exit_ts", "armed_ts").drop("entry_ts", "reason", "_first")


def next_confirmations(spine: DataFrame, signals: DataFrame) -> DataFrame:
    """Per bar, the number of the first bar at or after it that is bullish, and bearish."""
    c = F.col
    s = spine.join(signals.select("symbol", "date", "time", "signal"), ["symbol", "date", "time"], "left")
    s = s.select("symbol", "ord", (-F.unix_date("date")).alias("back_day"), (-c("ord")).alias("back"), "signal")
    words = {f"_{w}": ("max", F.when(c("signal") == w, c("back"))) for w in ("bullish", "bearish")}
    s = block_scan(s, ["symbol"], ["back_day"], ["back"], **words)
    return s.select("symbol", "ord", (-c("_bullish")).alias("next_bullish"), (-c("_bearish")).alias("next_bearish"))


def ready_bars(armed: DataFrame, runs: DataFrame, spine: DataFrame, confirmations: DataFrame | None) -> DataFrame:
    """The armed trackers with ``armed_ord`` and ``ready_ord``, the number of the first bar they are ready on.

    asap and same_time: the next bar; after_n_bars: n bars later, or as many as were left;
    momentum_confirm: the first later bar whose signal agrees with the leg's side (null: never).
    """
    c = F.col
    at = spine.select("symbol", c("ts").alias("armed_ts"), c("ord").alias("armed_ord"))
    legs = armed.join(runs.select("run_id", "symbol", "entry_time"), "run_id").join(at, ["symbol", "armed_ts"])
    legs = legs.withColumn("ord", c("armed_ord") + 1)
    if confirmations is None:
        confirmed = F.lit(None).cast("bigint")
    else:
        legs = legs.join(confirmations, ["symbol", "ord"], "left")
        confirmed = F.when(c("position") == "sell", c("next_bearish")).otherwise(c("next_bullish"))
    cooling = F.when(c("state") == COOLING, c("left")).otherwise(F.greatest(c("reentry_cooldown_bars"), F.lit(1)))
    ready = (
        F.when(c("reentry_mode") == "after_n_bars", c("armed_ord") + cooling)
        .when(c("reentry_mode") == "momentum_confirm", confirmed)
        .otherwise(c("ord"))
    )
    return legs.withColumn("ready_ord", ready.cast("bigint")).drop("ord", "next_bullish", "next_bearish")


def _asks(legs: DataFrame, runs: DataFrame, bars: DataFrame) -> DataFrame:
    """What each leg needs to open again, and as one text (``ask``): the option and expiry type, for a leg at a
    fixed offset that offset, and for a run with a same_time leg the entry time."""
    c = F.col
    same = legs.groupBy("run_id").agg(F.max(c("reentry_mode") == "same_time").alias("_same"))
    expiry = F.coalesce("expiry", F.lit("weekly")) if "expiry_type" in bars.columns else F.lit("")
    asks = legs.select("run_id", "option_type", "strike_mode", "strike_offset", expiry.alias("expiry")).join(same, "run_id")
    asks = asks.join(runs.select("run_id", "symbol", "entry_time"), "run_id").select(
        "run_id", "symbol", "option_type", "expiry",
        F.when(c("strike_mode") == "atm_offset", c("strike_offset")).alias("offset"),
        F.when(c("_same"), c("entry_time")).alias("clock"),
    )
    return asks.withColumn("ask", F.to_json(F.struct("option_type", "expiry", "offset", "clock"))).distinct()


def openings(asks: DataFrame, bars: DataFrame, spine: DataFrame) -> DataFrame:
    """For each symbol, ask and day: the times a contract is there, and the first moment of a later day (``later``).

    Built once and looked up in every pass; a key has one row for each day of the calendar.
    """
    c = F.col
    keys = cut_lineage(asks.drop("run_id").distinct())
    chain = bars.select("symbol", "option_type", expiry_of(bars).alias("expiry"), c("strike_offset").alias("at_offset"), c("date"), c("time"))
    met = chain.join(keys, ["symbol", "option_type", "expiry"]).where(
        (c("offset").isNull() | (c("offset") == c("at_offset"))) & (c("clock").isNull() | (c("clock") == c("time")))
    )
    met = met.groupBy("symbol", "ask", "date").agg(F.array_sort(F.collect_set("time")).alias("times"))
    days = spine.select("symbol", "date").distinct().join(keys.select("symbol", "ask"), "symbol").join(met, ["symbol", "ask", "date"], "left")
    ahead = Window.partitionBy("symbol", "ask").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    first = F.when(c("times").isNotNull(), bar_ts(c("date"), F.get("times", F.lit(0))))
    return days.withColumn("later", F.first(first, ignorenulls=True).over(ahead))


def reentry_times(ready: DataFrame, asks: DataFrame, opens: DataFrame, spine: DataFrame) -> DataFrame:
    """The bar each armed run opens again on: the first from its first ready bar on where a leg has a contract."""
    c = F.col
    first = ready.groupBy("run_id", "symbol", "armed_ts").agg(F.min("ready_ord").alias("ord"))
    first = first.join(spine.select("symbol", "ord", c("date"), c("time").alias("_from")), ["symbol", "ord"])
    asked = cut_lineage(first.join(asks.select("run_id", "ask"), "run_id"))
    found = opens.join(asked, ["symbol", "ask", "date"])
    today = F.get(F.filter("times", lambda t: t >= c("_from")), F.lit(0))
    found = found.withColumn("_next", F.coalesce(F.when(today.isNotNull(), bar_ts(c("date"), today)), c("later")))
    best = found.where(c("_next").isNotNull()).groupBy("run_id", "symbol", "armed_ts").agg(F.min("_next").alias("ts"))
    clock = F.substring(c("ts").cast("string"), 12, 8)
    return best.select("run_id", "symbol", "armed_ts", "ts", c("ts").cast("date").alias("date"), clock.alias("time"))


def held_days(again: DataFrame, runs: DataFrame, hz: DataFrame) -> DataFrame:
    """The days (symbol, date) on which positions opened at ``again`` may have bars."""
    spans = again.select("run_id", "symbol", "date").join(runs.select("run_id", "exit_time"), "run_id").join(hz, ["symbol", "exit_time", "date"])
    last = F.greatest("date", F.col("horizon_ts").cast("date"))
    return spans.select("symbol", F.explode(F.sequence("date", last)).alias("date")).distinct()


def still_open(exits: DataFrame, tracked: DataFrame) -> DataFrame:
    """The positions that can matter to the next event: those of tracked runs, from their last re-entry on.

    That re-entry is taken whatever came before, and nothing before it is asked for again.
    """
    c = F.col
    since = tracked.groupBy("run_id").agg(F.max("since").alias("_since"))
    return exits.join(since, "run_id").where(c("_since").isNull() | (c("entry_ts") >= c("_since"))).drop("_since")


def after_reentry(tracked: DataFrame, ready: DataFrame, again: DataFrame, spine: DataFrame) -> DataFrame:
    """Trackers of the runs that opened again: legs ready by then count it, the others keep what is left."""
    c = F.col
    at = again.select("run_id", "symbol", "ts").join(spine.select("symbol", "ts", "ord"), ["symbol", "ts"])
    armed = ready.select("run_id", "leg_no", "ready_ord")
    rows = tracked.join(at.select("run_id", c("ts").alias("_ts"), "ord"), "run_id").join(armed, ["run_id", "leg_no"], "left")
    # No column says whether a leg was armed but its row; a null bar is a signal that never comes.
    rows = rows.join(armed.select("run_id", "leg_no", F.lit(True).alias("_armed")), ["run_id", "leg_no"], "left")
    counts = F.coalesce(c("ready_ord") <= c("ord"), F.lit(False))
    cools = c("reentry_mode") == "after_n_bars"
    return rows.select(
        *[n for n in tracked.columns if n not in ("state", "left", "done", "since")],
        F.when(c("_armed").isNull() | counts, IDLE).when(cools, COOLING).otherwise(WAITING).alias("state"),
        F.when(c("_armed") & cools & ~counts, c("ready_ord") - c("ord")).otherwise(0).cast("bigint").alias("left"),
        (c("done") + counts.cast("int")).alias("done"),
        c("_ts").alias("since"),
    )


def with_reentries(opened, pos, runs, legs, bars, spine, signals, hz, evaluate):
    """Add the re-entries of all runs to the position bars and the opened legs.

    Every re-entry uses up an attempt of some leg, so there are at most as many passes as a run's
    legs have attempts together. A pass reads the runs that opened again in the one before, and the
    bars of the days their new positions may be held.
    """
    from .replay import EXIT, non_overlapping

    c = F.col
    spine = cut_lineage(spine)
    confirmations = None if signals is None else cut_lineage(next_confirmations(spine, signals))
    tracked = cut_lineage(trackers(legs))
    asks = cut_lineage(_asks(legs.join(tracked.select("run_id").distinct(), "run_id", "left_semi"), runs, bars))
    opens = cut_lineage(openings(asks, bars, spine))
    passes = tracked.groupBy("run_id").agg(F.sum("reentry_max_attempts").alias("n")).agg(F.max("n")).first()[0] or 0
    exits = cut_lineage(pos.where(c("reason").isNotNull()).select(*EXIT))
    never = F.lit(FAR).cast("timestamp_ntz")
    for attempt in range(1, passes + 1):
        mine = cut_lineage(still_open(exits, tracked))
        taken = mine.join(non_overlapping(mine), ["run_id", "entry_ts", "forced"], "left_semi").where(c("exit_ts") < never)
        armed = armed_trackers(taken, tracked)
        ready = cut_lineage(ready_bars(armed, runs, spine, confirmations))
        if ready.isEmpty():
            break
        again = cut_lineage(reentry_times(ready, asks, opens, spine))
        days = cut_lineage(held_days(again, runs, hz))
        more_open, more_pos = evaluate(again, cut_lineage(bars.join(days, ["symbol", "date"], "left_semi")))
        more_pos = cut_lineage(
            more_pos.join(again.select("run_id", c("ts").alias("entry_ts"), c("armed_ts").alias("start_ts")), ["run_id", "entry_ts"])
            .withColumn("forced", F.lit(True))
            .withColumn("attempt", F.lit(attempt))
        )
        # Armed without a later chance: the run waits for ever and takes no more entries.
        stuck = ready.select("run_id", "armed_ts").distinct().join(again.select("run_id"), "run_id", "left_anti")
        waits = stuck.select(
            "run_id", never.alias("entry_ts"), never.alias("exit_ts"), F.lit("waiting").alias("reason"),
            c("armed_ts").alias("start_ts"), F.lit(True).alias("forced"), F.lit(attempt).alias("attempt"),
        )
        pos = pos.unionByName(more_pos)
        # A regular entry on the very bar of a re-entry has the same legs.
        opened = opened.unionByName(more_open.join(opened.select("run_id", "entry_ts"), ["run_id", "entry_ts"], "left_anti"))
        more_exits = more_pos.where(c("reason").isNotNull()).select(*EXIT).unionByName(waits.select(*EXIT))
        exits = exits.unionByName(cut_lineage(more_exits))
        tracked = cut_lineage(after_reentry(tracked, ready, again, spine))
    return opened, pos, exits

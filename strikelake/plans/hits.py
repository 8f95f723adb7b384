"""First-hit index: the bars of a held contract once, whatever stops, targets and lots are tried on it.

Positions that hold the same contracts from the same entry to the same horizon share a frame. A frame
keeps, for each of its legs, the bars in time order with running extremes of everything a stop or a
target is measured by. A running extreme never falls back, so the first bar that reaches a threshold
is found by halving, and a sweep over thresholds and lots adds searches, not bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: What makes legs of different runs the same leg of a frame.
_LEG = ["leg_no", "option_type", "held_offset", "held_strike", "held_series", "position", "sign", "entry_price", "entry_spot"]
_SPAN = ["symbol", "entry_ts", "entry_date", "horizon_ts", "eod"]
_TERMS = [
    "leg_no", "quantity", "stop_loss_enabled", "stop_loss_type", "stop_loss_value",
    "target_profit_enabled", "target_profit_type", "target_profit_value",
]
_OVERALL = ["overall_sl_enabled", "overall_sl_type", "overall_sl_value", "overall_target_enabled", "overall_target_type", "overall_target_value"]
#: Running extremes by the threshold kinds that ask for them.
STOPS = {"points": "points", "percent_of_premium": "premium", "percent_of_margin": "margin", "index_points": "index", "delta_breach": "delta"}
TARGETS = {"points": "gain", "percent_of_premium": "gain_pct"}


def positions_of(opened: DataFrame) -> DataFrame:
    """One row a position: its frame's key, span and legs, and its own terms in leg order."""
    grouped = opened.groupBy("run_id", *_SPAN).agg(
        F.array_sort(F.collect_list(F.struct(*_LEG))).alias("legs"),
        F.array_sort(F.collect_list(F.struct(*_TERMS))).alias("terms"),
        *[F.first(o).alias(o) for o in _OVERALL],
    )
    # Doubles as text are exact, so equal keys are equal legs.
    return grouped.withColumn("frame", F.md5(F.to_json(F.struct(*_SPAN, "legs")).cast("binary")))


def index_frames(positions: DataFrame, held_bars, track_by: str) -> DataFrame:
    """Frames of ``positions``: frame, bars (ts and, for each leg, its state and running extremes so far).

    ``held_bars(legs, track_by)`` gives the bars of each held contract from entry to horizon.
    """
    frames = positions.select("frame", *_SPAN, "legs").dropDuplicates(["frame"])
    bars = held_bars(frames.select("frame", *_SPAN, F.inline("legs")), track_by)
    leg = Window.partitionBy("frame", "leg_no").orderBy("ts")
    sofar = leg.rowsBetween(Window.unboundedPreceding, 0)
    entry, sign = c("entry_price"), c("sign")
    lost, gained = -(c("worst") - entry) * sign, (c("best") - entry) * sign

    def share(amount: Column, of: Column) -> Column:
        return F.when(of > 0, amount / F.when(of > 0, of) * 100).otherwise(0.0)

    measures = {
        "points": lost,
        "premium": share(lost, entry),
        "margin": share(lost, F.greatest(entry * 3.0, c("entry_spot") * 0.12)),
        "index": (c("spot") - c("entry_spot")) * -sign,
        "delta": F.when(c("delta") != 0, F.abs("delta")),
        "gain": gained,
        "gain_pct": share(gained, entry),
    }
    state = F.struct(
        "leg_no", "close", "worst", "best", "spot", "entry_price", "sign", F.row_number().over(leg).alias("bars_held"),
        *[F.max(m).over(sofar).alias(name) for name, m in measures.items()],
    )
    rows = bars.select("frame", "ts", "leg_no", state.alias("state"))
    ends = frames.select("frame", c("horizon_ts").alias("ts"), F.transform("legs", lambda x: x["leg_no"]).alias("leg_nos"))
    at = rows.unionByName(ends, allowMissingColumns=True).groupBy("frame", "ts").agg(
        F.collect_list("state").alias("present"), F.max("leg_nos").alias("leg_nos")
    )
    at = at.withColumn("leg_nos", F.max("leg_nos").over(Window.partitionBy("frame")))
    grid = at.select("frame", "ts", F.explode("leg_nos").alias("leg_no"), "present").withColumn(
        "now", F.try_element_at(F.filter("present", lambda p: p["leg_no"] == c("leg_no")), F.lit(1))
    )
    grid = grid.withColumn("state", F.last("now", ignorenulls=True).over(sofar))
    moments = grid.groupBy("frame", "ts").agg(F.array_sort(F.collect_list("state")).alias("states"))
    return moments.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("ts", "states"))).alias("bars"))


def lower_bound(bars: Column, leg: Column, measure: str, value: Column) -> Column:
    """Number of the first of ``bars`` where ``leg``'s running ``measure`` reaches ``value``, by halving; the size if none does."""
    n = F.size(bars)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        hit = F.coalesce(F.get(F.get(bars, middle)["states"], leg)[measure] >= value, F.lit(False))
        closer = F.when(hit, F.struct(acc["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi")))
        return F.when(acc["lo"] < acc["hi"], closer).otherwise(acc)

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]


def _first(places: Column, n: Column) -> Column:
    """Least of the places, ``n`` if there is none."""
    return F.coalesce(F.array_min(places), n)


def _first_true(flags: Column, n: Column) -> Column:
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def exits(positions: DataFrame, frames: DataFrame, overall_hit, thin: bool = False) -> DataFrame:
    """Bars of each position up to its exit: run_id, entry_ts, ts, exit_ts, unrealized, reason and states (on the last).

    The reasons are tried in the order stop, overall stop, target, overall target, horizon. With
    ``thin`` only each day's last bar and the exit's are given.
    """
    p = positions.drop("legs").join(frames.hint("merge") if thin else frames, "frame")
    bars, terms = c("bars"), c("terms")
    n = F.size("bars")

    def leg_hits(enabled: str, kind: str, value: str, kinds: dict[str, str]) -> Column:
        def of_leg(t: Column, i: Column) -> Column:
            found = F.lit(None).cast("int")
            for name, measure in kinds.items():
                found = F.when(t[kind] == name, lower_bound(bars, i, measure, t[value])).otherwise(found)
            return F.when(t[enabled], found)

        return _first(F.transform(terms, of_leg), n)

    p = p.withColumn("_sl", leg_hits("stop_loss_enabled", "stop_loss_type", "stop_loss_value", STOPS))
    p = p.withColumn("_tg", leg_hits("target_profit_enabled", "target_profit_type", "target_profit_value", TARGETS))

    def pnl(state: Column, term: Column) -> Column:
        return (state["close"] - state["entry_price"]) * state["sign"] * term["quantity"]

    def summed(bar: Column) -> Column:
        return F.aggregate(F.zip_with(bar["states"], terms, pnl), F.lit(0.0), lambda a, x: a + x)

    p = p.withColumn("_open", F.transform("bars", summed))
    entered = F.zip_with(F.get("bars", F.lit(0))["states"], terms, lambda s, t: s["entry_price"] * t["quantity"])
    p = p.withColumn("_premium", F.aggregate(entered, F.lit(0.0), lambda a, x: a + x))

    def overall(side: str, sign: int, kinds: list[str]) -> Column:
        hit = F.transform("_open", lambda x: overall_hit(c(f"overall_{side}_type"), c(f"overall_{side}_value"), x * sign, c("_premium"), kinds))
        return F.when(c(f"overall_{side}_enabled"), _first_true(hit, n)).otherwise(n)

    p = p.withColumn("_osl", overall("sl", -1, ["combined_premium", "points"])).withColumn("_otg", overall("target", 1, ["points"]))
    p = p.withColumn("_at", F.least("_sl", "_osl", "_tg", "_otg", n - 1))
    reason = (
        F.when(c("_sl") == c("_at"), "stop_loss")
        .when(c("_osl") == c("_at"), "combined_sl")
        .when(c("_tg") == c("_at"), "target")
        .when(c("_otg") == c("_at"), "combined_target")
        .when(c("eod"), "end_of_data")
        .otherwise("time_exit")
    )
    last = F.get("bars", c("_at"))
    kept = F.zip_with(
        last["states"], terms,
        lambda s, t: F.struct(
            s["leg_no"].alias("leg_no"), s["close"].alias("close"), s["worst"].alias("worst"), s["best"].alias("best"), s["spot"].alias("spot"),
            pnl(s, t).alias("pnl"), (s["entry_price"] * t["quantity"]).alias("premium"), s["bars_held"].alias("bars_held"),
        ),
    )

    def day(i: Column) -> Column:
        return F.get("bars", i)["ts"].cast("date")

    places = F.sequence(F.lit(0), c("_at"))
    if thin:
        places = F.filter(places, lambda i: (i == c("_at")) | (day(i) != day(i + 1)))
    rows = p.select("run_id", "entry_ts", last["ts"].alias("exit_ts"), reason.alias("_reason"), kept.alias("_states"), "_at", "_open", "bars", F.explode(places).alias("i"))
    closing = c("i") == c("_at")
    return rows.select(
        "run_id", "entry_ts", F.get("bars", c("i"))["ts"].alias("ts"), "exit_ts", F.get("_open", c("i")).alias("unrealized"),
        F.when(closing, c("_reason")).alias("reason"), F.when(closing, c("_states")).alias("states"),
    )

"""Spine of bar times, and the contract each leg opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bar_ts
from .ordered import ordinal

DEFAULT_PREMIUM = 200.0


def expiry_of(bars: DataFrame) -> Column:
    """Expiry type of each bar; the empty text where bars hold one type only and do not name it."""
    return F.coalesce("expiry_type", F.lit("")) if "expiry_type" in bars.columns else F.lit("")


def series_of(bars: DataFrame) -> Column:
    """Which contract a bar of a given offset belongs to: its expiry type and, where known, its expiry date."""
    kind = expiry_of(bars)
    return F.concat_ws("@", kind, F.col("expiry_date").cast("string")) if "expiry_date" in bars.columns else kind


def bar_spine(bars: DataFrame) -> DataFrame:
    """One row per symbol and bar time; spot is that of the first contract in chain order."""
    return (
        bars.groupBy("symbol", "date", "time")
        .agg(F.min_by("spot", F.struct("strike_offset", "option_type", expiry_of(bars))).alias("spot"))
        .withColumn("ts", bar_ts())
    )


def with_ordinals(spine: DataFrame) -> DataFrame:
    """Bar number within the symbol (``ord``), counted by day and then over days."""
    return ordinal(spine, ["symbol"], ["date"], ["time"], "ord")


def entry_candidates(spine: DataFrame, runs: DataFrame) -> DataFrame:
    """Bar times equal to a run's entry time."""
    at = runs.select("run_id", "symbol", F.col("entry_time").alias("time"))
    return spine.join(at, ["symbol", "time"]).select("run_id", "symbol", "date", "time", "ts")


def select_contract(wanted: DataFrame, legs: DataFrame, bars: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Contract per (run, entry time, leg); legs without a match are absent.

    ``wanted`` has run_id, symbol, date, time, ts. Modes: ``atm_offset`` needs that exact
    offset; ``premium`` takes the close nearest to the target, ``percent_otm`` the nearest
    offset, ``delta`` the nearest delta; ties go to the lower offset. A delta leg without
    usable greeks takes the money strike, or else the lowest strike. Where bars name their expiry
    type, a leg takes contracts of its ``expiry`` only (weekly, if it names none), and ``held_series``
    says which expiry it holds. ``times`` (one column,
    ``time``) names the only bar times that can be asked for.
    """
    if times is not None:
        # Distinct times of day: never more than 86,400 short strings.
        bars = bars.join(F.broadcast(times.select("time").distinct()), "time", "left_semi")
    has_delta = "delta" in bars.columns
    pick = legs.select(
        "run_id",
        "leg_no",
        "option_type",
        "strike_mode",
        F.col("strike_offset").alias("wanted_offset"),
        F.coalesce("premium_target", F.lit(DEFAULT_PREMIUM)).alias("premium_target"),
        "delta_target",
        (F.coalesce("expiry", F.lit("weekly")) if "expiry_type" in bars.columns else F.lit("")).alias("expiry"),
    )
    asked = wanted.select("run_id", "symbol", "date", "time", "ts").join(pick, "run_id")
    chain = bars.select(
        "symbol",
        "date",
        "time",
        "option_type",
        F.col("strike_offset").alias("held_offset"),
        F.col("close").alias("raw_price"),
        F.col("spot").alias("entry_spot"),
        expiry_of(bars).alias("expiry"),
        series_of(bars).alias("held_series"),
        (F.col("strike") if "strike" in bars.columns else F.lit(None).cast("double")).alias("held_strike"),
        (F.col("delta") if has_delta else F.lit(None).cast("double")).alias("_delta"),
    )
    c = F.col
    found = asked.join(chain, ["symbol", "date", "time", "option_type", "expiry"]).where(
        (c("strike_mode") != "atm_offset") | (c("held_offset") == c("wanted_offset"))
    )
    usable = c("_delta").isNotNull() & ~F.isnan("_delta") & (c("_delta") != 0) & c("delta_target").isNotNull()
    by_delta = F.when(usable, F.abs(F.abs("_delta") - F.abs("delta_target"))).otherwise(
        F.when(c("held_offset") == 0, 1e6).otherwise(2e6)
    )
    distance = (
        F.when(c("strike_mode") == "premium", F.abs(c("raw_price") - c("premium_target")))
        .when(c("strike_mode") == "percent_otm", F.abs(c("held_offset") - c("wanted_offset")).cast("double"))
        .when(c("strike_mode") == "delta", by_delta)
        .otherwise(0.0)
    )
    best = found.groupBy("run_id", "symbol", "date", "time", "ts", "leg_no", "option_type").agg(
        F.min_by(
            F.struct("held_offset", "held_strike", "held_series", "raw_price", "entry_spot"),
            F.struct(distance.alias("d"), c("held_offset").alias("o"), c("raw_price").alias("p")),
        ).alias("_b")
    )
    return best.select("run_id", "symbol", "date", "time", "ts", "leg_no", "option_type", "_b.*")


def horizons(spine: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest possible exit per (symbol, exit_time, date of entry).

    The first bar at or after the exit time, on the entry day or the next day that has one;
    otherwise the symbol's last bar, flagged ``eod``. Works on one row per symbol and day.
    """
    c = F.col
    days = spine.groupBy("symbol", "date").agg(F.array_sort(F.collect_list("time")).alias("_times"), F.max("ts").alias("_last"))
    exits = runs.select("symbol", "exit_time").distinct()
    d = days.join(exits, "symbol").withColumn(
        "_hit", F.try_element_at(F.filter("_times", lambda t: t >= c("exit_time")), F.lit(1))
    )
    ahead = Window.partitionBy("symbol", "exit_time").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("symbol", "exit_time")
    hit = F.first(F.when(c("_hit").isNotNull(), bar_ts(c("date"), c("_hit"))), ignorenulls=True).over(ahead)
    d = d.withColumn("_ts", hit).withColumn("_end", F.max("_last").over(whole))
    return d.select(
        "symbol",
        "exit_time",
        "date",
        F.coalesce("_ts", "_end").alias("horizon_ts"),
        c("_ts").isNull().alias("eod"),
    )

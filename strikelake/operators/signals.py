"""Momentum signals over the spine: RSI, EMA cross, range breakout, supertrend.

Wilder and exponential averages are recurrences y -> a*y + x. Such maps compose, so each
(symbol, day) block is folded on its own from zero, the blocks' ends are folded over the days
of a symbol, and a block's rows add the carried value times the product of their factors. A factor
may change from row to row, so an average's seed is part of the same recurrence: a mean of the
first n values is a sum with factor 1, a first value has factor 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .contracts import with_ordinals
from .ordered import block_scan, carry_forward


def affine_scan(df: DataFrame, **channels: tuple[Column, Column]) -> DataFrame:
    """Add ``name=(a, x)`` per row: y_i = a_i * y_{i-1} + x_i in bar order per symbol, from zero.

    All channels run in one scan, and rows travel with it. A null ``x`` counts as 0. One day of
    bars is at most 1,440 rows; of a symbol's days only one short row each is gathered.
    """
    c, names = F.col, list(channels)
    maps = [F.struct(a.cast("double").alias("a"), F.coalesce(x, F.lit(0.0)).alias("x")).alias(n) for n, (a, x) in channels.items()]
    kept = [n for n in df.columns if n not in ("symbol", "date", *names)]
    bar = F.struct("time", F.struct(*maps).alias("maps"), F.struct(*kept).alias("row"))
    days = df.select("symbol", "date", bar.alias("bar")).groupBy("symbol", "date").agg(F.collect_list("bar").alias("bars"))
    days = days.select("symbol", "date", F.array_sort("bars", lambda l, r: F.when(l["time"] < r["time"], -1).when(l["time"] > r["time"], 1).otherwise(0)).alias("bars"))

    def values(pick) -> Column:
        return F.struct(*[F.struct(*[v.alias(k) for k, v in zip("yp", pick(n))]).alias(n) for n in names])

    shape = "struct<" + ",".join(f"`{n}`:struct<y:double,p:double>" for n in names) + ">"

    def scan(items: Column, step) -> Column:
        """Every running value of ``items``, the start first."""
        zero = values(lambda n: (F.lit(0.0), F.lit(1.0)))
        start = F.struct(zero.alias("now"), F.array(zero).cast(f"array<{shape}>").alias("all"))

        def add(acc, item):
            now = values(lambda n: step(acc["now"][n], item, n))
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(items, start, add)["all"]

    def inside(was, bar, n):
        m = bar["maps"][n]
        return was["y"] * m["a"] + m["x"], was["p"] * m["a"]

    days = days.withColumn("found", scan(c("bars"), inside))
    # The values a day starts from: its predecessors' maps, composed.
    ends = F.array_sort(F.collect_list(F.struct("date", F.element_at("found", -1).alias("end"))))

    def over_days(was, day, n):
        return was["y"] * day["end"][n]["p"] + day["end"][n]["y"], was["p"] * day["end"][n]["p"]

    carried = days.groupBy("symbol").agg(ends.alias("ends"))
    carried = carried.select("symbol", F.explode(F.arrays_zip(c("ends.date").alias("date"), scan(c("ends"), over_days).alias("from"))).alias("d"))
    carried = carried.select("symbol", "d.date", c("d.from").alias("from")).where("date IS NOT NULL")
    rows = days.join(carried, ["symbol", "date"]).select(
        "symbol", "date", "from", F.explode(F.arrays_zip(c("bars.row").alias("row"), F.slice("found", 2, F.size("bars")).alias("found"))).alias("r")
    )
    results = [(c(f"r.found.{n}.y") + c(f"from.{n}.y") * c(f"r.found.{n}.p")).alias(n) for n in names]
    return rows.select("symbol", "date", *[c(f"r.row.{k}").alias(k) for k in kept], *results).select(*[n for n in df.columns if n not in names], *names)


def with_changes(spine: DataFrame) -> DataFrame:
    """Numbered bars with the change of spot since the previous bar (NULL on the first)."""
    s = block_scan(spine, ["symbol"], ["date"], ["time"], ord=("count", F.lit(1)), _prev=("lag", F.col("spot")))
    return s.withColumn("change", F.col("spot") - F.col("_prev")).drop("_prev")


def _wilder(value: Column, period: int) -> tuple[Column, Column]:
    """Average of changes: the mean of the first ``period``, then each new one weighs 1/period."""
    return F.when(F.col("ord") <= period + 1, 1.0).otherwise((period - 1) / period), value / period


def rsi(spine: DataFrame, period: int = 14) -> DataFrame:
    """Wilder RSI; NULL until ``period`` changes have been seen."""
    c = F.col
    gain = F.greatest(c("change"), F.lit(0.0))
    loss = F.greatest(-c("change"), F.lit(0.0))
    s = affine_scan(with_changes(spine), _avg_gain=_wilder(gain, period), _avg_loss=_wilder(loss, period))
    flat = c("_avg_loss") == 0
    value = F.when(flat, 100.0).otherwise(100.0 - 100.0 / (1.0 + c("_avg_gain") / F.when(~flat, c("_avg_loss"))))
    return s.withColumn("rsi", F.when(c("ord") > period, value)).drop("_avg_gain", "_avg_loss")


def _word(up: Column, down: Column) -> Column:
    return F.when(up, "bullish").when(down, "bearish").otherwise("neutral")


def rsi_signal(spine: DataFrame, period: int = 14, above: float = 60.0, below: float = 40.0) -> DataFrame:
    r = rsi(spine, period)
    return r.withColumn("signal", _word(F.col("rsi") > above, F.col("rsi") < below))


def emas(spine: DataFrame, **periods: int) -> DataFrame:
    """Exponential averages of spot (``name=period``), each seeded with the first spot, in one scan."""
    s = spine if "ord" in spine.columns else with_ordinals(spine)
    first, spot = F.col("ord") == 1, F.col("spot")
    weights = {n: 2.0 / (p + 1.0) for n, p in periods.items()}
    return affine_scan(s, **{n: (F.when(first, 0.0).otherwise(1.0 - k), F.when(first, spot).otherwise(spot * k)) for n, k in weights.items()})


def ema(spine: DataFrame, period: int, out: str = "ema") -> DataFrame:
    return emas(spine, **{out: period})


def ema_cross_signal(spine: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    s = emas(spine, ema_fast=fast, ema_slow=slow)
    return s.withColumn("signal", _word(F.col("ema_fast") > F.col("ema_slow"), F.col("ema_fast") < F.col("ema_slow")))


def range_breakout_signal(spine: DataFrame, range_end: str) -> DataFrame:
    """Spot beyond the day's range up to ``range_end``; neutral while it forms."""
    day = Window.partitionBy("symbol", "date")
    forming = F.col("time") <= range_end
    s = spine.withColumn("range_high", F.max(F.when(forming, F.col("spot"))).over(day))
    s = s.withColumn("range_low", F.min(F.when(forming, F.col("spot"))).over(day))
    up = ~forming & (F.col("spot") > F.col("range_high"))
    down = ~forming & (F.col("spot") < F.col("range_low"))
    return s.withColumn("signal", _word(up, down))


def supertrend_signal(spine: DataFrame, period: int = 7, multiplier: float = 3.0) -> DataFrame:
    """Trend by ratcheting bands around spot, from the bar where the ATR is seeded."""
    c = F.col
    s = affine_scan(with_changes(spine), atr=_wilder(F.abs("change"), period))
    s = cut_lineage(s.withColumn("atr", F.when(c("ord") > period, c("atr"))))
    width = multiplier * c("atr")
    s = block_scan(s, ["symbol"], ["date"], ["time"], upper=("min", c("spot") + width), lower=("max", c("spot") - width))
    s = cut_lineage(s)
    flip = F.when(c("spot") > c("upper"), "bullish").when(c("spot") < c("lower"), "bearish")
    s = carry_forward(s.withColumn("_flip", F.when(c("atr").isNotNull(), flip)), ["symbol"], ["date"], ["time"], c("_flip"), "_trend")
    signal = F.when(c("atr").isNull(), "neutral").otherwise(F.coalesce("_trend", F.lit("bullish")))
    return s.withColumn("signal", signal).drop("_flip", "_trend")


def signal_at(points: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal per (symbol, date, time); neutral where there is none."""
    s = signals.select("symbol", "date", "time", "signal")
    return points.join(s, ["symbol", "date", "time"], "left").withColumn("signal", F.coalesce("signal", F.lit("neutral")))


def momentum_entries(candidates: DataFrame, signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entry candidates whose signal is the run's wanted direction (run_id, direction)."""
    return (
        signal_at(candidates, signals)
        .join(wanted.select("run_id", "direction"), "run_id")
        .where(F.col("signal") == F.col("direction"))
        .drop("signal", "direction")
    )

"""Several strategies together: combined equity, correlation, margin and portfolio metrics."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pricing import leg_margin, strategy_margin
from . import metrics as M
from . import replay as R

RISK_FREE = 0.065
DAYS = 252.0


def portfolio_runs(bars: DataFrame, runs: DataFrame, legs: DataFrame, allocations: DataFrame, **options) -> R.Replay:
    """Replay of all strategies in one plan, each with its allocated capital.

    ``allocations``: portfolio, run_id, allocation_pct, allocated_capital, optional lot_size.
    """
    cols = ["run_id", F.col("allocated_capital").alias("_cap")]
    sized = "lot_size" in allocations.columns
    if sized:
        cols.append(F.col("lot_size").alias("_lot"))
    a = allocations.select(*cols)
    r = runs.join(a, "run_id").withColumn("capital", F.col("_cap"))
    if sized:
        r = r.withColumn("lot_size", F.coalesce("_lot", "lot_size"))
    return R.replay(bars, r.select(*runs.columns), legs, **options)


def combined_equity(daily: DataFrame, allocations: DataFrame) -> DataFrame:
    """Sum of the strategies' daily equity per portfolio date, each carried forward.

    Before its first point a strategy counts with its allocated capital.
    """
    c = F.col
    eq = daily.join(allocations.select("portfolio", "run_id", "allocated_capital"), "run_id")
    dates = eq.select("portfolio", "date").distinct()
    spine = dates.join(allocations.select("portfolio", "run_id", "allocated_capital"), "portfolio")
    full = spine.join(eq.select("portfolio", "run_id", "date", "equity"), ["portfolio", "run_id", "date"], "left")
    w = Window.partitionBy("portfolio", "run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("equity", ignorenulls=True).over(w), c("allocated_capital"))
    total = full.withColumn("_e", filled).groupBy("portfolio", "date").agg(F.sum("_e").alias("equity"))
    prev = F.lag("equity").over(Window.partitionBy("portfolio").orderBy("date"))
    ret = F.when(prev.isNull(), None).when(prev > 0, c("equity") / F.when(prev > 0, prev) - 1).otherwise(0.0)
    return total.withColumn("daily_return", ret)


def correlation_matrix(daily: DataFrame, allocations: DataFrame) -> DataFrame:
    """Pearson correlation of daily P&L per pair of strategies of a portfolio.

    Dates are aligned; pairs with fewer than two common days or no variation give 0. The days of a
    portfolio are gathered as vectors, one entry a strategy, and every vector's products are summed
    where it stands, so what is shuffled are strategies times days and one sum a pair and task.
    """
    c = F.col
    w = Window.partitionBy("run_id").orderBy("date")
    pnl = daily.select("run_id", "date", (c("equity") - F.lag("equity").over(w)).alias("pnl")).where(c("pnl").isNotNull())
    p = pnl.join(allocations.select("portfolio", "run_id"), "run_id")
    days = p.groupBy("portfolio", "date").agg(F.array_sort(F.collect_list(F.struct("run_id", "pnl"))).alias("v"))
    firsts = days.select("portfolio", "v", F.posexplode("v").alias("at", "a"))
    products = firsts.select("portfolio", "a", F.explode(F.slice("v", c("at") + 2, F.size("v"))).alias("b"))
    products = products.select("portfolio", c("a.run_id").alias("strategy_a"), c("b.run_id").alias("strategy_b"), c("a.pnl").alias("x"), c("b.pnl").alias("y"))
    found = products.groupBy("portfolio", "strategy_a", "strategy_b").agg(
        F.count(F.lit(1)).alias("_n"), F.covar_pop("x", "y").alias("_xy"), F.sqrt(F.var_pop("x") * F.var_pop("y")).alias("_d")
    )
    ids = allocations.select("portfolio", "run_id")
    pairs = ids.select("portfolio", c("run_id").alias("strategy_a")).join(ids.select("portfolio", c("run_id").alias("strategy_b")), "portfolio")
    half = pairs.where(c("strategy_a") < c("strategy_b")).join(found, ["portfolio", "strategy_a", "strategy_b"], "left")
    usable = (c("_n") >= 2) & (c("_d") * c("_n") >= 1e-12)
    r = F.when(usable, c("_xy") / F.when(usable, c("_d")))
    half = half.select("portfolio", "strategy_a", "strategy_b", F.coalesce(r, F.lit(0.0)).alias("correlation"))
    mirrored = half.select("portfolio", c("strategy_b").alias("strategy_a"), c("strategy_a").alias("strategy_b"), "correlation")
    own = ids.select("portfolio", c("run_id").alias("strategy_a"), c("run_id").alias("strategy_b"), F.lit(1.0).alias("correlation"))
    return half.unionByName(mirrored).unionByName(own)


def avg_correlation(matrix: DataFrame) -> DataFrame:
    m = matrix.where(F.col("strategy_a") < F.col("strategy_b"))
    return m.groupBy("portfolio").agg(F.avg("correlation").alias("avg_correlation"))


def position_margins(trades: DataFrame, by=("portfolio", "run_id", "entry_ts", "exit_ts")) -> DataFrame:
    """Margin locked by each position: leg margins with the hedge benefit."""
    qty = (F.col("lots") * F.col("lot_size")).cast("double")
    legs = trades.withColumn("leg_margin", leg_margin(F.col("entry_price"), F.col("entry_spot"), qty))
    return strategy_margin(legs, list(by)).withColumnRenamed("strategy_margin", "margin")


def margin_timeline(positions: DataFrame) -> DataFrame:
    """Margin in use after each moment; exits at a moment free margin before entries take it.

    Events are summed per moment first, so the running sum has one row per distinct bar time.
    """
    c = F.col
    events = positions.select(
        "portfolio",
        F.explode(
            F.array(
                F.struct(c("entry_ts").alias("ts"), c("margin").alias("delta")),
                F.struct(c("exit_ts").alias("ts"), (-c("margin")).alias("delta")),
            )
        ).alias("_e"),
    )
    at = events.groupBy("portfolio", c("_e.ts").alias("ts")).agg(F.sum("_e.delta").alias("delta"))
    w = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("margin_used", F.sum("delta").over(w))


def peak_margin(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("portfolio").agg(F.greatest(F.max("margin_used"), F.lit(0.0)).alias("peak_margin_used"))


def margin_admission(positions: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Accept or skip each entry in time order while margin is available.

    Returns the positions with accepted, available_margin (before the entry) and reason. A skipped
    position never holds margin; one that ends at a moment frees its margin before that moment's
    entries, which follow in the order of run_id, exit and margin. The decision on an entry
    depends on all before it, so a portfolio's entries pass through one task as a sorted stream;
    what the task holds is a heap of the positions open at that moment, by exit. Margins are added
    and taken away as exact fractions, so nothing drifts however many have come and gone.
    """
    c = F.col
    kept = ["portfolio", "run_id", "entry_ts", "exit_ts", "margin"]
    asked = positions.select(*kept).join(portfolios.select("portfolio", c("total_capital").cast("double").alias("total_capital")), "portfolio")
    asked = asked.withColumn("margin", c("margin").cast("double"))
    order = ["portfolio", "entry_ts", "run_id", "exit_ts", "margin"]
    names = [*kept, "accepted", "available_margin"]

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, total = None, [], Fraction(0)
        for batch in batches:
            ts = [batch.column(k).cast(pa.int64()).to_pylist() for k in ("entry_ts", "exit_ts")]
            accepted, available = [], []
            for portfolio, start, end, margin, capital in zip(
                batch.column("portfolio").to_pylist(), *ts, batch.column("margin").to_pylist(), batch.column("total_capital").to_pylist()
            ):
                if portfolio != name:
                    name, held, total = portfolio, [], Fraction(0)
                while held and held[0][0] <= start:
                    total -= heapq.heappop(held)[1]
                left = float(Fraction(capital) - total)
                accepted.append(margin <= left)
                available.append(left)
                if accepted[-1]:
                    heapq.heappush(held, (end, Fraction(margin)))
                    total += Fraction(margin)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(accepted, pa.bool_()), pa.array(available, pa.float64())], names=names
            )

    schema = T.StructType([*asked.select(*kept).schema, T.StructField("accepted", T.BooleanType()), T.StructField("available_margin", T.DoubleType())])
    out = asked.repartition("portfolio").sortWithinPartitions(*order).mapInArrow(admit, schema)
    return out.withColumn("reason", F.when(~c("accepted"), "insufficient_margin"))


def portfolio_metrics(
    combined: DataFrame,
    daily: DataFrame,
    trades: DataFrame,
    matrix: DataFrame,
    peaks: DataFrame,
    portfolios: DataFrame,
    allocations: DataFrame,
    bar_counts: DataFrame,
) -> DataFrame:
    """One row per portfolio. ``bar_counts``: run_id, total_bars."""
    c = F.col
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    r = c("daily_return")
    dd = combined.withColumn("_dd", F.when(peak > 0, (peak - c("equity")) / F.when(peak > 0, peak) * 100).otherwise(0.0))
    base = dd.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("_points"), F.count(r).alias("_n"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"),
        F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / F.count(r)).alias("_down"),
        F.max("_dd").alias("portfolio_max_drawdown_pct"), F.max_by("equity", "date").alias("_last"),
        F.date_diff(F.max("date"), F.min("date")).alias("_days"),
    )
    vol = M.daily_series(daily).groupBy("run_id").agg(F.coalesce(F.stddev_samp("daily_return"), F.lit(0.0)).alias("_vol"))
    shares = allocations.join(vol, "run_id", "left").groupBy("portfolio").agg(
        (F.sum(c("allocation_pct") * F.coalesce("_vol", F.lit(0.0))) / F.sum("allocation_pct")).alias("_weighted")
    )
    book = allocations.select("portfolio", "run_id").join(trades, "run_id").groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("pnl_net").alias("portfolio_total_pnl"), F.sum("bars_held").alias("_held")
    )
    bars_of = allocations.join(bar_counts, "run_id", "left").groupBy("portfolio").agg(F.avg(F.coalesce("total_bars", F.lit(0))).alias("_bars"))
    j = portfolios.select("portfolio", "total_capital")
    for part in (base, shares, book, bars_of, avg_correlation(matrix), peaks):
        j = j.join(part, "portfolio", "left")
    j = j.na.fill(0.0, ["portfolio_total_pnl", "_bars", "avg_correlation", "peak_margin_used", "portfolio_max_drawdown_pct"]).na.fill(0, ["total_trades", "_held"])
    root = math.sqrt(DAYS)

    def annual(dev: str):
        ok = (c("_n") >= 2) & (c(dev) >= 1e-12)
        return F.coalesce(F.when(ok, (c("_mean") * DAYS - RISK_FREE) / (F.when(ok, c(dev)) * root)), F.lit(0.0))

    def per(num, den, floor=0.0):
        return F.coalesce(F.when(den > floor, num / F.when(den > floor, den)), F.lit(0.0))

    years = c("_days") / 365.25
    grown = (c("_points") >= 2) & (c("total_capital") > 0) & (years >= 0.01)
    return j.select(
        "portfolio",
        annual("_std").alias("portfolio_sharpe"),
        annual("_down").alias("portfolio_sortino"),
        "portfolio_max_drawdown_pct",
        "portfolio_total_pnl",
        F.coalesce(F.when(grown, (F.pow(c("_last") / c("total_capital"), 1 / F.when(grown, years)) - 1) * 100), F.lit(0.0)).alias("portfolio_cagr"),
        "peak_margin_used",
        per(c("portfolio_total_pnl"), c("peak_margin_used")).alias("capital_efficiency"),
        F.when(c("_bars") >= 1, c("_held") / F.when(c("_bars") >= 1, c("_bars"))).otherwise(0.0).alias("avg_concurrent_trades"),
        F.coalesce(
            F.when((c("_n") >= 2) & (c("_weighted") * root >= 1e-12), F.greatest(1 - c("_std") / F.when(c("_weighted") > 0, c("_weighted")), F.lit(0.0))), F.lit(0.0)
        ).alias("diversification_benefit"),
        "avg_correlation",
        per(c("peak_margin_used"), c("total_capital")).alias("avg_margin_utilization"),
        "total_trades",
    )

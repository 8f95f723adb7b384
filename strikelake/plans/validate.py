"""Data checks on bars, and rule checks on strategy and portfolio tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import uncovered_dates
from ..session import cut_lineage

BAR_KEY = ["date", "time", "strike_offset", "option_type"]


def _violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(broken)).alias("rule"))


def validate_strategies(runs: DataFrame, legs: DataFrame) -> DataFrame:
    """(run_id, rule) for every broken configuration rule; none means valid."""
    c = F.col
    again = c("reentry_on_sl") | c("reentry_on_target")
    leg_rules = {
        "lots_not_positive": c("lots") <= 0,
        "trail_without_activation": c("trail_sl_enabled") & (c("trail_sl_activate_at") <= 0),
        "lock_without_share": c("trail_sl_enabled") & (c("trail_sl_mode") == "lock") & (c("trail_sl_lock_in") <= 0),
        "stop_without_value": c("stop_loss_enabled") & (c("stop_loss_value") <= 0),
        "target_without_value": c("target_profit_enabled") & (c("target_profit_value") <= 0),
        "momentum_without_filter": (c("reentry_mode") == "momentum_confirm") & ~c("momentum_filter_enabled"),
        "cooldown_not_positive": (c("reentry_mode") == "after_n_bars") & again & (c("reentry_cooldown_bars") <= 0),
    }
    counted = runs.join(legs.groupBy("run_id").agg(F.count(F.lit(1)).alias("_legs")), "run_id", "left")
    run_rules = {
        "no_legs": c("_legs").isNull(),
        "capital_not_positive": c("capital") <= 0,
        "entry_not_before_exit": c("entry_time") >= c("exit_time"),
        "overall_stop_needs_two_legs": c("overall_sl_enabled") & (F.coalesce(c("_legs"), F.lit(0)) < 2),
    }
    by_leg = _violations(legs, ["run_id", "leg_no"], leg_rules)
    by_run = _violations(counted, ["run_id"], run_rules)
    return by_run.withColumn("leg_no", F.lit(None).cast("int")).unionByName(by_leg).select("run_id", "leg_no", "rule")


def validate_portfolio(portfolios: DataFrame, allocations: DataFrame) -> DataFrame:
    """(portfolio, rule) for broken portfolio rules; shares must add to 100 within 0.5."""
    c = F.col
    sums = allocations.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("allocation_pct").alias("_sum"), F.min("allocation_pct").alias("_low")
    )
    joined = portfolios.join(sums, "portfolio", "left")
    return _violations(
        joined,
        ["portfolio"],
        {
            "no_strategies": c("_n").isNull(),
            "capital_not_positive": c("total_capital") <= 0,
            "allocation_not_positive": c("_low") <= 0,
            "allocations_not_100": F.abs(c("_sum") - 100) > 0.5,
        },
    )


def allocated_capital(portfolios: DataFrame, allocations: DataFrame) -> DataFrame:
    share = F.col("total_capital") * F.col("allocation_pct") / 100
    return allocations.join(portfolios.select("portfolio", "total_capital"), "portfolio").withColumn("allocated_capital", share)


def _verdict(df: DataFrame, check: str, errors: Column, warnings: Column, detail: Column) -> DataFrame:
    return df.select(
        "symbol", F.lit(check).alias("check"), (errors == 0).alias("passed"), errors.cast("bigint").alias("n_errors"),
        warnings.cast("bigint").alias("n_warnings"), detail.cast("double").alias("detail"),
    )


def bar_times(bars: DataFrame) -> DataFrame:
    """What all checks read: one row for each symbol, expiry type, date and bar time.

    symbol, expiry_type (empty where bars hold one type and do not name it), date, time, rows, keys
    (different contracts), points (rows with a usable IV), spots (different ones, sorted). A chain is
    a few dozen contracts, so a row is small. A table that is already one is handed back.
    """
    if {"rows", "keys", "points", "spots"} <= set(bars.columns):
        return bars
    kind = F.coalesce("expiry_type", F.lit("")) if "expiry_type" in bars.columns else F.lit("")
    contract = [k for k in BAR_KEY if k not in ("date", "time")]
    measures = {
        "rows": F.count(F.lit(1)),
        "keys": F.size(F.collect_set(F.struct(*contract))) if set(contract) <= set(bars.columns) else F.count(F.lit(1)),
        "points": F.count_if(F.col("iv") > 0) if "iv" in bars.columns else F.lit(0),
        "spots": F.array_sort(F.collect_set("spot")) if "spot" in bars.columns else F.array().cast("array<double>"),
    }
    time = F.col("time") if "time" in bars.columns else F.lit("")
    return bars.groupBy("symbol", kind.alias("expiry_type"), "date", time.alias("time")).agg(*[m.alias(n) for n, m in measures.items()])


def date_gaps(bars: DataFrame, max_days: int = 5) -> DataFrame:
    """Consecutive bar dates of a symbol further apart than ``max_days``."""
    days = bars.select("symbol", "date").distinct()
    w = Window.partitionBy("symbol").orderBy("date")
    g = days.withColumn("previous", F.lag("date").over(w)).withColumn("days", F.date_diff("date", "previous"))
    return g.where(F.col("days") > max_days)


def check_date_gaps(bars: DataFrame, max_days: int = 5, max_gaps: int = 20) -> DataFrame:
    n = bars.groupBy("symbol").agg(F.count_distinct("date").alias("_days"))
    g = date_gaps(bars, max_days).groupBy("symbol").agg(F.count(F.lit(1)).alias("_g"))
    j = n.join(g, "symbol", "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    few = (F.col("_days") < 2).cast("int")
    return _verdict(j, "date_gaps", (F.col("_g") > max_gaps).cast("int"), F.col("_g") + few, F.col("_g"))


def check_duplicates(bars: DataFrame) -> DataFrame:
    """Rows beyond the first of each key, within a month file (one for each expiry type)."""
    files = bar_times(bars).groupBy("symbol", "expiry_type", F.year("date").alias("_y"), F.month("date").alias("_m")).agg(
        F.sum(F.col("rows") - F.col("keys")).alias("_extra")
    )
    d = files.groupBy("symbol").agg(F.sum("_extra").alias("_dup"), F.count_if(F.col("_extra") > 0).alias("_files"))
    return _verdict(d, "duplicates", (F.col("_dup") > 0).cast("int"), F.col("_files"), F.col("_dup"))


def check_iv_coverage(bars: DataFrame, low: float = 95.0, good: float = 99.0, points: int = 3) -> DataFrame:
    """Share of bar times of an expiry type (with any usable IV) that have enough points for a surface."""
    some = F.count_if(F.col("points") > 0)
    s = bar_times(bars).groupBy("symbol").agg((F.count_if(F.col("points") >= points) / F.nullif(some, F.lit(0)) * 100).alias("_pct"))
    pct = F.col("_pct")
    return _verdict(
        s, "iv_coverage", F.coalesce((pct < low).cast("int"), F.lit(0)),
        F.coalesce(((pct >= low) & (pct < good)).cast("int"), F.lit(0)), F.round(pct, 4),
    )


def spot_jumps(bars: DataFrame, limit: float = 0.10) -> DataFrame:
    """Adjacent distinct spots of a month file (one for each expiry type) that differ by more than ``limit``."""
    spots = bar_times(bars).select("symbol", "expiry_type", "date", "time", F.explode("spots").alias("spot"))
    w = Window.partitionBy("symbol", "expiry_type", F.year("date"), F.month("date")).orderBy("date", "time", "spot")
    s = spots.withColumn("previous", F.lag("spot").over(w))
    change = F.abs(F.col("spot") - F.col("previous")) / F.when(F.col("previous") > 0, F.col("previous"))
    return s.withColumn("change", change).where(F.col("change") > limit)


def check_spot_continuity(bars: DataFrame, limit: float = 0.10) -> DataFrame:
    j = spot_jumps(bars, limit).groupBy("symbol").agg(F.count(F.lit(1)).alias("_j"))
    s = bars.select("symbol").distinct().join(j, "symbol", "left").withColumn("_j", F.coalesce("_j", F.lit(0)))
    return _verdict(s, "spot_continuity", (F.col("_j") > 0).cast("int"), F.lit(0), F.col("_j"))


def check_lot_coverage(bars: DataFrame, lot_rules: DataFrame) -> DataFrame:
    miss = uncovered_dates(bars, lot_rules).groupBy("symbol").agg(F.count(F.lit(1)).alias("_u"))
    s = bars.select("symbol").distinct().join(miss, "symbol", "left").withColumn("_u", F.coalesce("_u", F.lit(0)))
    return _verdict(s, "lot_coverage", (F.col("_u") > 0).cast("int"), F.lit(0), F.col("_u"))


def check_weekly_cutoff(bars: DataFrame, expiry_rules: DataFrame) -> DataFrame:
    """Month files of the wrong expiry type around the first monthly rule of a symbol."""
    cut = expiry_rules.where(F.col("type") == "monthly").groupBy(F.upper("symbol").alias("_s")).agg(F.min("from_date").alias("_cut"))
    files = bars.groupBy("symbol", "expiry_type", F.year("date").alias("_y"), F.month("date").alias("_m")).agg(
        F.min("date").alias("_lo"), F.max("date").alias("_hi")
    )
    j = files.join(cut, F.upper("symbol") == F.col("_s"), "left")
    bad = ((F.col("expiry_type") == "weekly") & (F.col("_hi") >= F.col("_cut"))) | (
        (F.col("expiry_type") == "monthly") & (F.col("_lo") < F.col("_cut"))
    )
    s = j.groupBy("symbol").agg(
        F.count_if(F.coalesce(bad, F.lit(False))).alias("_e"), F.max(F.col("_cut").isNull().cast("int")).alias("_w")
    )
    return _verdict(s, "weekly_cutoff", F.col("_e"), F.col("_w"), F.col("_e"))


def validate_bars(bars: DataFrame, expiry_rules: DataFrame, lot_rules: DataFrame) -> DataFrame:
    """One row per symbol and check; the bars are read once, for ``bar_times``, which is written."""
    times = cut_lineage(bar_times(bars))
    checks = [
        check_weekly_cutoff(times, expiry_rules), check_date_gaps(times), check_duplicates(times), check_iv_coverage(times),
        check_spot_continuity(times), check_lot_coverage(times, lot_rules),
    ]
    out = checks[0]
    for one in checks[1:]:
        out = out.unionByName(one)
    return out

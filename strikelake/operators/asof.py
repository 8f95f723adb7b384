"""Lookups in date-ranged rule tables: lot sizes and expiry calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import monthly_expiry, next_weekday, weekday_code


def _resolve(df: DataFrame, rules: DataFrame, symbol: str, date: str, values: list[str]) -> DataFrame:
    """Rule values per distinct (symbol, date); the earliest-starting rule wins, of equal ones the weekly or least.

    Only the distinct pairs meet the ranges, so the range condition never sees the fact rows
    and a symbol with most of the rows costs no more than any other.
    """
    keys = df.select(F.col(symbol).alias("_s"), F.col(date).alias("_d")).distinct()
    r = rules.select(
        F.upper("symbol").alias("_rs"), F.col("from_date").alias("_f"), F.col("to_date").alias("_t"), *values
    )
    hit = keys.join(r, (F.upper("_s") == F.col("_rs")) & F.col("_d").between(F.col("_f"), F.col("_t")))
    ties = [F.col(v) != "weekly" if v == "type" else F.col(v) for v in values]
    order = F.struct("_f", "_t", *[t.alias(f"_o{i}") for i, t in enumerate(ties)])
    return hit.groupBy("_s", "_d").agg(F.min_by(F.struct(*values), order).alias("_v"))


def lot_size_asof(df: DataFrame, rules: DataFrame, symbol: str = "symbol", date: str = "entry_date", out: str = "lot_size", default: int | None = None) -> DataFrame:
    """Add the lot size in force; NULL (or ``default``) without a rule."""
    found = _resolve(df, rules, symbol, date, ["size"])
    joined = df.join(found, (F.col(symbol) == F.col("_s")) & (F.col(date) == F.col("_d")), "left")
    size = F.col("_v.size")
    if default is not None:
        size = F.coalesce(size, F.lit(default))
    return joined.withColumn(out, size).drop("_s", "_d", "_v")


def expiry_asof(df: DataFrame, rules: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Add expiry_date, expiry_type and dte by the calendar rule in force."""
    found = _resolve(df, rules, symbol, date, ["type", "day"])
    code = weekday_code(F.col("_v.day"))
    kind = F.col("_v.type")
    expiry = F.when(kind == "weekly", next_weekday(F.col("_d"), code)).when(kind == "monthly", monthly_expiry(F.col("_d"), code))
    found = found.select("_s", "_d", F.when(expiry.isNotNull(), kind).alias("expiry_type"), expiry.alias("expiry_date"))
    found = found.withColumn("dte", F.date_diff("expiry_date", "_d"))
    joined = df.join(found, (F.col(symbol) == F.col("_s")) & (F.col(date) == F.col("_d")), "left")
    return joined.drop("_s", "_d")


def roll_table(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Expiry that a contract of each (symbol, expiry_type, date) of ``keys`` runs to: those and expiry_date.

    The rule in force is the earliest-starting one of that type; keys without one are left out.
    """
    k = keys.select("symbol", "expiry_type", "date").distinct()
    r = rules.select(F.upper("symbol").alias("_s"), F.col("type").alias("_type"), "day", F.col("from_date").alias("_f"), F.col("to_date").alias("_t"))
    met = k.join(r, (F.upper("symbol") == F.col("_s")) & (F.col("expiry_type") == F.col("_type")) & F.col("date").between(F.col("_f"), F.col("_t")))
    rule = met.groupBy("symbol", "expiry_type", "date").agg(F.min_by("day", F.struct("_f", "_t")).alias("day"))
    code = weekday_code(F.col("day"))
    expiry = F.when(F.col("expiry_type") == "weekly", next_weekday("date", code)).when(F.col("expiry_type") == "monthly", monthly_expiry("date", code))
    return rule.select("symbol", "expiry_type", "date", expiry.alias("expiry_date")).where("expiry_date IS NOT NULL")


def with_expiry_dates(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """``bars`` (with expiry_type) with the expiry_date of their contracts, null without a rule."""
    return bars.join(roll_table(bars, rules), ["symbol", "expiry_type", "date"], "left")


def expiry_gate(candidates: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop entries on expiry day for runs that do not trade it."""
    kept = candidates.columns
    dated = expiry_asof(candidates, rules).join(runs.select("run_id", "trade_on_expiry"), "run_id")
    return dated.where(F.col("trade_on_expiry") | F.col("dte").isNull() | (F.col("dte") > 0)).select(*kept)


def uncovered_dates(dates: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, date) pairs without any rule."""
    d = dates.select("symbol", "date").distinct()
    r = rules.select(F.upper("symbol").alias("_rs"), "from_date", "to_date")
    return d.join(
        r,
        (F.upper("symbol") == F.col("_rs")) & F.col("date").between(F.col("from_date"), F.col("to_date")),
        "left_anti",
    )

"""Dates, times of day and expiry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def norm_time(v: Column | str) -> Column:
    """``HH:mm:ss`` from ``HH:mm[:ss]``; anything else is midnight."""
    t = _c(v)
    return (
        F.when(t.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), t)
        .when(t.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(t, F.lit(":00")))
        .otherwise(F.lit("00:00:00"))
    )


def bar_ts(date: Column | str = "date", time: Column | str = "time") -> Column:
    """Zone-free timestamp of a bar; comparisons need no session time zone."""
    return F.concat_ws(" ", _c(date).cast("string"), _c(time)).cast("timestamp_ntz")


def weekday_code(day: Column | str) -> Column:
    """``Wednesday`` or ``last_wednesday`` to ``WED``; NULL when it names no weekday."""
    bare = F.upper(F.regexp_replace(F.lower(_c(day)), "^last_", ""))
    names = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
    return F.when(bare.isin(names), F.substring(bare, 1, 3))


def next_weekday(date: Column | str, code: Column) -> Column:
    """First such weekday on or after ``date``."""
    return F.call_function("next_day", F.date_sub(_c(date), 1), code)


def last_weekday_of_month(date: Column | str, code: Column) -> Column:
    return F.call_function("next_day", F.date_sub(F.last_day(_c(date)), 7), code)


def monthly_expiry(date: Column | str, code: Column) -> Column:
    """Last such weekday of the month, rolled to the next month once it has passed."""
    d = _c(date)
    here = last_weekday_of_month(d, code)
    return F.when(d <= here, here).otherwise(last_weekday_of_month(F.add_months(F.trunc(d, "MM"), 1), code))


def shift_months(date: Column | str, months: Column | int) -> Column:
    """Calendar shift whose day of month is clamped to 28."""
    d = _c(date)
    m = months if isinstance(months, Column) else F.lit(months)
    slot = F.month(d) - 1 + m
    return F.make_date(
        (F.year(d) + F.floor(slot / 12)).cast("int"),
        (F.pmod(slot, F.lit(12)) + 1).cast("int"),
        F.least(F.dayofmonth(d), F.lit(28)),
    )


def month_label(year: Column | str, month: Column | str) -> Column:
    return F.concat_ws(
        "-",
        F.lpad(_c(year).cast("string"), 4, "0"),
        F.lpad(_c(month).cast("string"), 2, "0"),
    )

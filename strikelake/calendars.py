"""Expiry and lot-size rules as small tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# Exchange expiry rules (symbol, from, to, type, day).
EXPIRY_RULES = [
    ("BANKNIFTY", "2000-01-01", "2023-09-03", "weekly", "Thursday"),
    ("BANKNIFTY", "2023-09-04", "2024-11-13", "weekly", "Wednesday"),
    ("BANKNIFTY", "2024-11-14", "2099-12-31", "monthly", "last_wednesday"),
    ("NIFTY", "2000-01-01", "2099-12-31", "weekly", "Thursday"),
    ("SENSEX", "2000-01-01", "2024-12-31", "weekly", "Friday"),
    ("SENSEX", "2025-01-01", "2099-12-31", "weekly", "Tuesday"),
]

# Contract lot sizes (symbol, from, to, size).
LOT_RULES = [
    ("NIFTY", "2000-01-01", "2024-04-25", 50),
    ("NIFTY", "2024-04-26", "2024-11-19", 25),
    ("NIFTY", "2024-11-20", "2099-12-31", 75),
    ("BANKNIFTY", "2000-01-01", "2024-11-19", 15),
    ("BANKNIFTY", "2024-11-20", "2099-12-31", 30),
    ("SENSEX", "2000-01-01", "2024-11-19", 10),
    ("SENSEX", "2024-11-20", "2099-12-31", 20),
]


def _dated(rules):
    return [(r[0], dt.date.fromisoformat(r[1]), dt.date.fromisoformat(r[2]), *r[3:]) for r in rules]


def expiry_rules(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(_dated(rules or EXPIRY_RULES), "symbol string, from_date date, to_date date, type string, day string")


def lot_rules(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(_dated(rules or LOT_RULES), "symbol string, from_date date, to_date date, size int")

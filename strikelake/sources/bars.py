"""Option-chain bars: partitioned Parquet in and out, CSV ingest, normalisation, inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.clock import norm_time

PARTITIONS = ["symbol", "expiry_type", "year", "month"]
CHAIN_ORDER = ["date", "time", "strike_offset", "option_type"]


def month_predicate(start: dt.date | None, end: dt.date | None) -> Column:
    """Partition filter equal to the date range; months are not inferred from dates. No bound, no filter."""
    slot, kept = F.col("year") * 12 + F.col("month"), F.lit(True)
    if start is not None:
        kept = kept & (F.col("year") >= start.year) & (slot >= start.year * 12 + start.month)
    if end is not None:
        kept = kept & (F.col("year") <= end.year) & (slot <= end.year * 12 + end.month)
    return kept


def read_bars(spark: SparkSession, base: str) -> DataFrame:
    """All bars under ``base`` with the fixed schema; an absent folder is an empty result."""
    schema = T.StructType(S.BARS.fields + S.BAR_PARTITIONS.fields)
    try:
        return spark.read.schema(schema).parquet(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_bars(
    spark: SparkSession,
    base: str,
    symbols: list[str] | None = None,
    expiry_types: list[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Bars of the symbols, expiry types and dates; partitions and row groups are pruned.

    A selection or bound that is not given leaves nothing out.
    """
    bars = read_bars(spark, base).where(month_predicate(start, end))
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin([s.lower() for s in symbols] + list(symbols)))
    if expiry_types is not None:
        bars = bars.where(F.col("expiry_type").isin(expiry_types))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end))
    return normalize_bars(bars)


def normalize_bars(bars: DataFrame) -> DataFrame:
    """Fixed types for any vintage: clock text, whole volumes, a timestamp, no NULLs."""
    have = set(bars.columns)
    clock = norm_time("time")
    stamp = F.concat_ws(" ", F.col("date").cast("string"), clock)
    out = []
    for f in S.BARS.fields:
        kind = f.dataType.typeName()
        if f.name == "date":
            col = F.col("date").cast("date")
        elif f.name == "time":
            col = clock
        elif f.name == "timestamp":
            col = F.coalesce(F.col("timestamp").cast("string"), stamp) if "timestamp" in have else stamp
        elif f.name not in have:
            col = F.lit(None).cast(f.dataType)
        elif kind in ("long", "integer"):
            # Whole numbers go straight, as doubles hold them up to 2^53 only.
            col = F.coalesce(F.col(f.name).try_cast(f.dataType), F.col(f.name).try_cast("double").try_cast(f.dataType))
        else:
            col = F.col(f.name).try_cast(f.dataType)
        if kind in ("double", "long", "integer"):
            col = F.coalesce(col, F.lit(0).cast(f.dataType))
        elif kind == "string":
            col = F.coalesce(col, F.lit(""))
        out.append(col.alias(f.name))
    return bars.select(*[p for p in PARTITIONS if p in have], *out)


def union_vintages(*frames: DataFrame) -> DataFrame:
    """Bars of several layouts as one normalised frame."""
    first, *rest = [normalize_bars(f) for f in frames]
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def file_listing(spark: SparkSession, base: str) -> DataFrame:
    """One row a data file under ``base``: its partition values, path, name, bytes and time of change.

    The files are listed as opaque ones whose content is not asked for, so nothing in them is read.
    """
    # Spark adds a recursive listing's partition folders only if it is told where they start.
    files = spark.read.format("binaryFile").option("basePath", base).option("pathGlobFilter", "*.parquet").load(base)
    known = [c for c in PARTITIONS if c in files.columns]
    return files.select(
        *known, "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


def list_available(spark: SparkSession, base: str) -> DataFrame:
    """(symbol, expiry_type, year, month) that have files under ``base``; no bar is read."""
    return file_listing(spark, base).select(*PARTITIONS).distinct()


def file_inventory(spark: SparkSession, base: str) -> DataFrame:
    """One row per data file: path, name, size in bytes and MB, modification time; no bar is read."""
    files = file_listing(spark, base).select("path", "name", "bytes", "modified")
    return files.withColumn("size_mb", F.round(F.col("bytes") / 1048576.0, 2))


def storage_total(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576.0, 2).alias("size_mb"),
    )


def ingest_csv(spark: SparkSession, path: str, symbol: str, expiry_type: str = "weekly") -> DataFrame:
    """17-column CSV to bars. Bad numbers become 0 (a decimal in an integer column is bad);
    rows without a valid date are dropped."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in S.BARS.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    return parse_rows(raw).withColumns(
        {
            "symbol": F.lit(symbol),
            "expiry_type": F.lit(expiry_type),
            "year": F.year("date"),
            "month": F.month("date"),
        }
    )


def parse_rows(raw: DataFrame) -> DataFrame:
    """All-text bar rows to typed ones."""
    out = []
    for f in S.BARS.fields:
        kind = f.dataType.typeName()
        text = F.trim(F.col(f.name))
        if kind == "date":
            col = F.try_to_date(text, "yyyy-MM-dd")
        elif kind in ("long", "integer"):
            col = F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(f.dataType)), F.lit(0).cast(f.dataType))
        elif kind == "double":
            col = F.coalesce(text.try_cast("double"), F.lit(0.0))
        else:
            col = F.col(f.name)
        out.append(col.alias(f.name))
    return raw.select(*out).where(F.col("date").isNotNull())


def write_bars(bars: DataFrame, base: str, mode: str = "append", files_per_month: int = 1) -> None:
    """Partitioned snappy Parquet, in chain order inside each file.

    A month of one symbol may be spread over several files by day, so that one busy symbol
    does not become one task.
    """
    slice_ = F.pmod(F.dayofmonth("date"), F.lit(files_per_month))
    (
        bars.repartition(*PARTITIONS, slice_)
        .sortWithinPartitions(*PARTITIONS, *CHAIN_ORDER)
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy(*PARTITIONS)
        .parquet(base)
    )

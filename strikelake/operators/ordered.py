"""Running values over long ordered sequences, without one task per sequence.

A window over all rows of one run, or one symbol, would put that whole run in one task.
Here the order is cut into blocks (normally the day): rows are scanned inside their block,
each block is reduced to one row, the reduced rows are scanned per key, and the result is
joined back by block. The key-wide window only ever sees one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def block_scan(df: DataFrame, keys, block, order, **outputs: tuple[str, Column]) -> DataFrame:
    """Add running values per key: ``name=(kind, value)``, all in one pass and one join back.

    Kinds: ``sum``, ``max``, ``min``, ``last`` (latest non-null), ``lag`` (value of the row before)
    and ``count`` (row number; its value is ignored). NULLs are skipped, but by ``lag``; a running
    sum starts from zero.
    """
    inside = Window.partitionBy(*keys, *block).orderBy(*order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    local, per_block, carried, final = [], [], [], []
    for i, (name, (kind, value)) in enumerate(outputs.items()):
        w, b, k = f"_w{i}", f"_b{i}", f"_c{i}"
        if kind == "count":
            local.append(F.row_number().over(inside).alias(w))
            per_block.append(F.count(F.lit(1)).alias(b))
            carried.append(F.sum(b).over(before).alias(k))
            done = (F.coalesce(k, F.lit(0)) + F.col(w)).cast("bigint")
        elif kind == "sum":
            local.append(F.sum(value).over(sofar).alias(w))
            per_block.append(F.sum(value).alias(b))
            carried.append(F.sum(b).over(before).alias(k))
            done = F.coalesce(k, F.lit(0)) + F.coalesce(w, F.lit(0))
        elif kind == "last":
            local.append(F.last(value, ignorenulls=True).over(sofar).alias(w))
            per_block.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(b))
            carried.append(F.last(b, ignorenulls=True).over(before).alias(k))
            done = F.coalesce(w, k)
        elif kind == "lag":
            local.append(F.struct(F.lag(value).over(inside).alias("v"), (F.row_number().over(inside) == 1).alias("head")).alias(w))
            per_block.append(F.max_by(value, at).alias(b))
            carried.append(F.lag(b).over(Window.partitionBy(*keys).orderBy(*block)).alias(k))
            done = F.when(F.col(w)["head"], F.col(k)).otherwise(F.col(w)["v"])
        else:
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            local.append(agg(value).over(sofar).alias(w))
            per_block.append(agg(value).alias(b))
            carried.append(agg(b).over(before).alias(k))
            done = pick(k, w)
        final.append(done.alias(name))
    blocks = df.groupBy(*keys, *block).agg(*per_block).select(*keys, *block, *carried)
    kept = [c for c in df.columns if c not in outputs]
    return df.select("*", *local).join(blocks, [*keys, *block]).select(*kept, *final)


def running_sum(df: DataFrame, keys, block, order, value: Column, out: str) -> DataFrame:
    return block_scan(df, keys, block, order, **{out: ("sum", value)})


def running_max(df: DataFrame, keys, block, order, value: Column, out: str) -> DataFrame:
    return block_scan(df, keys, block, order, **{out: ("max", value)})


def running_min(df: DataFrame, keys, block, order, value: Column, out: str) -> DataFrame:
    return block_scan(df, keys, block, order, **{out: ("min", value)})


def carry_forward(df: DataFrame, keys, block, order, value: Column, out: str) -> DataFrame:
    """Latest non-null value at or before each row."""
    return block_scan(df, keys, block, order, **{out: ("last", value)})


def ordinal(df: DataFrame, keys, block, order, out: str = "ord") -> DataFrame:
    """1-based position of each row in its key's order."""
    return block_scan(df, keys, block, order, **{out: ("count", F.lit(1))})


def range_blocks(df: DataFrame, order: list, block: str = "block") -> DataFrame:
    """Add a block id by range-partitioning on the full order.

    Sampled ranges split a hot run or a hot day just like any other stretch of the order,
    so no block depends on how the keys are distributed. ``order`` starts with the keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn(block, F.spark_partition_id())


def number_rows(df: DataFrame, keys, order, out: str) -> DataFrame:
    """1-based row number per key for keys of any size.

    Rows are sorted inside sampled ranges and written once with their place, so that both readers see
    the same range bounds. A number is the place within the key's rows of that range, plus the key's rows
    in earlier ranges: one row a key and range is joined back, and no other row is moved again.
    """
    ranged = range_blocks(df, [*keys, *order]).sortWithinPartitions(*keys, *order)
    blocked = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    parts = blocked.groupBy(*keys, "block").agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = cut_lineage(parts.select(*keys, "block", "_head", F.coalesce(before, F.lit(0)).alias("_before")))
    number = (F.col("_before") + F.col("_at") - F.col("_head") + 1).cast("bigint")
    return blocked.join(parts, [*keys, "block"]).select(*[c for c in df.columns if c != out], number.alias(out))


def streaks(df: DataFrame, keys, order, flag: Column, prefix: str = "") -> DataFrame:
    """Longest run of true and of false rows per key, in order.

    Each range block is reduced to its islands' lengths: the first, the last and the
    longest of either kind, and whether it is one single island. Islands that touch a block
    border are then stitched over the blocks of a key, of which there are at most as many as
    shuffle partitions.
    """
    rows = range_blocks(df.withColumn("_f", flag), [*keys, *order])
    w = Window.partitionBy("block", *keys).orderBy(*order)
    rows = rows.withColumn("_new", F.when(F.col("_f") == F.lag("_f").over(w), 0).otherwise(1))
    rows = rows.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "block", "_isl").agg(F.first("_f").alias("_f"), F.count(F.lit(1)).alias("_n"))
    part = islands.groupBy(*keys, "block").agg(
        F.min_by(F.struct("_f", "_n"), F.col("_isl")).alias("head"),
        F.max_by(F.struct("_f", "_n"), F.col("_isl")).alias("tail"),
        F.max("_isl").alias("n_isl"),
        F.max(F.when(F.col("_f"), F.col("_n"))).alias("best_t"),
        F.max(F.when(~F.col("_f"), F.col("_n"))).alias("best_f"),
    )
    # One pass over ``part``: the sampled bounds may differ between two evaluations of it.
    # A border island continues when the next block starts with the same flag, so heads
    # (pos 0) and tails (pos 1) are numbered over the blocks; inner bests stand alone.
    def piece(border: bool, pos: int, e: Column) -> Column:
        return F.struct(F.lit(border).alias("border"), F.lit(pos).alias("pos"), e["_f"].alias("_f"), e["_n"].alias("_n"))

    def best(flag_value: bool, col: str) -> Column:
        return piece(False, 2, F.struct(F.lit(flag_value).alias("_f"), F.coalesce(F.col(col), F.lit(0)).alias("_n")))

    inner = [best(True, "best_t"), best(False, "best_f")]
    one = F.array(piece(True, 0, F.col("head")), *inner)
    two = F.array(piece(True, 0, F.col("head")), piece(True, 1, F.col("tail")), *inner)
    pieces = part.select(*keys, "block", F.explode(F.when(F.col("n_isl") == 1, one).otherwise(two)).alias("x")).select(
        *keys, "block", "x.*"
    )
    v = Window.partitionBy(*keys, "border").orderBy("block", "pos", "_f")
    joined = F.col("border") & (F.col("_f") == F.lag("_f").over(v)) & (F.col("pos") == 0)
    pieces = pieces.withColumn("_new", F.when(joined, 0).otherwise(1))
    pieces = pieces.withColumn("_isl", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = pieces.groupBy(*keys, "border", "_isl").agg(F.first("_f").alias("_f"), F.sum("_n").alias("_n"))
    return lengths.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_f"), F.col("_n"))), F.lit(0)).cast("bigint").alias(f"{prefix}max_true"),
        F.coalesce(F.max(F.when(~F.col("_f"), F.col("_n"))), F.lit(0)).cast("bigint").alias(f"{prefix}max_false"),
    )

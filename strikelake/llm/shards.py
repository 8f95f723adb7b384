"""Shards that each match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import in_order, random_key


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, source) into one of ``shards`` shards of equal row counts.

    Rows of each source stand in seeded-random order; the row of rank r (from 0) of n has the
    fractional rank (2 r + 1) / (2 n). All rows sorted by it are cut into ``shards`` runs whose
    lengths differ by one at most, so that every shard holds each source's share within a row.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless
    from 0 in each shard, in the interleaved order). A null source is a source of its own, a null
    text has size 1 and the crc of no bytes. Rows of one id and text are interchangeable. Only ids,
    sources and digests move; texts stay where they are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        random_key(seed, F.col("doc_id"), F.col("text")).alias("key"),
    )
    ranked = in_order(rows, [F.col("source").asc_nulls_first(), F.col("key")])
    sources = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("at"))
    sources = cut_lineage(sources.select(F.col("source").alias("of"), "n", "at"))
    spread = ranked.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        *rows.columns, ((2 * (F.col("position") - F.col("at")) + 1) / (2 * F.col("n"))).alias("fraction")
    )
    placed = in_order(spread, [F.col("fraction"), F.col("source").asc_nulls_first(), F.col("key")])
    total = sources.agg(F.sum("n")).first()[0] or 0
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot")
    )

"""What several operators of this folder need: words, folds, sorted positions, labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Fixed values of the two word rules: what stands between words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other letter left as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``: runs of digits, a-z and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def n_words_of(text: Column) -> Column:
    """Number of runs between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def random_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A key as good as random that depends on the seed, the id and the text only."""
    return F.md5(
        F.concat_ws(
            "|",
            F.lit(str(seed)),
            F.coalesce(doc_id.cast("string"), F.lit("")),
            F.md5(F.coalesce(text, F.lit("")).cast("binary")),
        ).cast("binary")
    )


def in_order(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in the global order of ``order``, written once, with its place in that order.

    Adds ``position`` (0 for the first row) and, for each name in ``sums``, ``before_<name>``: the
    sum of that column over all earlier rows. Every range of the order is one task that keeps only
    running totals; the totals of the ranges, one row a range, are added up apart. Ranges are
    sampled from the order itself, so that equal leading values do not gather in one task.
    """
    schema = T.StructType(
        [*df.schema, T.StructField("in_range", T.IntegerType()), T.StructField("position", T.LongType())]
        + [T.StructField(f"before_{c}", T.LongType()) for c in sums]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, totals = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            n = batch.num_rows
            added = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))]
            for c in sums:
                values = batch.column(batch.schema.names.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = totals[c] + np.cumsum(values)
                added.append(pa.array(ends - values))
                totals[c] = int(ends[-1]) if n else totals[c]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    stored = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    totals = stored.groupBy("in_range").agg(
        F.count(F.lit(1)).alias("range_rows"), *[F.sum(c).alias(f"range_{c}") for c in sums]
    )
    earlier = Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "in_range",
        F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("base_rows"),
        *[F.coalesce(F.sum(f"range_{c}").over(earlier), F.lit(0)).alias(f"base_{c}") for c in sums],
    )
    # One row for each range: never more than there are shuffle partitions.
    placed = stored.join(F.broadcast(bases), "in_range")
    return placed.select(
        *df.columns,
        (F.col("position") + F.col("base_rows")).alias("position"),
        *[(F.col(f"before_{c}") + F.col(f"base_{c}")).alias(f"before_{c}") for c in sums],
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents outside the held-out fold: doc_id, text, label.

    Rows are taken in the order of a hash of their id, so reruns agree. Labels that are null or
    contradict each other, and null ids, are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("at"))
        .orderBy("at", "doc_id")
        .limit(max_rows)
        .select("doc_id", "label")
    )
    # max_rows rows of two numbers at most.
    return docs.select("doc_id", "text").join(F.broadcast(cut_lineage(known)), "doc_id")

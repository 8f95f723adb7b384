"""Token ids as directly addressable codes: random access to any token without decoding a block.

A segment holds the ids of some whole documents. Each id is cut into chunks of ``chunk_bits``, the
lowest first. Level 0 has the first chunk of every id, level 1 the second chunk of those that have
one, and so on. A bitmap of each level says which ids go on; a rank directory counts its ones before
every 512 bits, so that the place of an id in the next level is a look-up and at most one
population count. Fixed layout, little-endian: magic ``DAC1``, chunk bits (u8), levels (u8), zero
(u16), number of ids of each level (u64 each), then for each level its chunks, its bitmap (padded
to 8 bytes) and its directory (u32).

On disk a token set is a folder: ``segments`` (one row for each segment: its range of the id order,
its number in it, first token counted in the range, document ids and token counts, and the codes)
and ``ranges`` (first token of each range). Parquet holds the codes uncompressed, so that they stay
addressable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import Encoder

#: Fixed values of the layout.
MAGIC, STEP, HEAD = b"DAC1", 512, 8

SEGMENT_TOKENS = 1 << 18
SEGMENTS = "in_range int, segment long, first long, n_tokens long, doc_ids array<long>, counts array<long>, codes binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def pack(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The layout above for an array of unsigned numbers; ``chunk_bits`` is 8 or 16."""
    kind = {8: "<u1", 16: "<u2"}[chunk_bits]
    rest, sizes, parts = ids.astype("<u8"), [], []
    while True:
        more = rest >= (1 << chunk_bits)
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        sizes.append(len(rest))
        parts += [
            (rest & ((1 << chunk_bits) - 1)).astype(kind).tobytes(),
            bits + bytes(-len(bits) % 8),
            (np.cumsum(ones) - ones).astype("<u4").tobytes(),
        ]
        rest = rest[more] >> np.uint64(chunk_bits)
        if not len(rest):
            break
    head = MAGIC + bytes([chunk_bits, len(sizes), 0, 0]) + np.array(sizes, "<u8").tobytes()
    return head + b"".join(parts)


class Codes:
    """Reads packed codes where they lie; nothing is decoded ahead."""

    def __init__(self, packed: bytes):
        if packed[:4] != MAGIC:
            raise ValueError("not packed codes")
        self.chunk_bits, n_levels = packed[4], packed[5]
        kind = {8: "<u1", 16: "<u2"}[self.chunk_bits]
        self.levels, at = [], HEAD + 8 * n_levels
        for n in np.frombuffer(packed, "<u8", n_levels, HEAD).tolist():
            chunks = np.frombuffer(packed, kind, n, at)
            at += chunks.nbytes
            bits = np.frombuffer(packed, "u1", (n + 7) // 8, at)
            at += -(-bits.nbytes // 8) * 8
            ranks = np.frombuffer(packed, "<u4", -(-n // STEP), at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, i: int) -> int:
        """The id at place ``i``."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STEP
            before = bits[block * STEP // 8 : i >> 3]
            last = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + last.bit_count()
            shift += self.chunk_bits
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids at places ``begin`` to ``end`` (not included)."""
        out, where, shift = np.zeros(max(0, end - begin), "<u4"), None, 0
        for chunks, bits, ranks in self.levels:
            if end <= begin:
                break
            part = chunks[begin:end].astype("<u4") << np.uint32(shift)
            if where is None:
                out |= part
            else:
                out[where] |= part
            block = begin // STEP
            flags = np.unpackbits(bits[block * STEP // 8 : -(-end // 8)], bitorder="little")[: end - block * STEP]
            skip = begin - block * STEP
            lower = (int(ranks[block]) if len(ranks) else 0) + int(np.count_nonzero(flags[:skip]))
            more = np.flatnonzero(flags[skip:])
            where = more if where is None else where[more]
            begin, end, shift = lower, lower + len(more), shift + self.chunk_bits
        return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, chunk_bits: int = 8, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write a token set to the new folder ``path``.

    Documents lie in ascending doc_id order, null ids first, rows of one id by the hash of their
    text; ``end_id`` follows each. Null and empty texts hold the end id alone. Texts are sorted in
    sampled ranges of that order, one task each, and only a segment's ids are held at a time.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        part, number, first = TaskContext.get().partitionId(), 0, 0
        names, counts, held, tokens = [], [], [], 0

        def close() -> pa.RecordBatch:
            columns = [[part], [number], [first], [tokens], [names], [counts], [pack(np.frombuffer(b"".join(held), "<u4"), chunk_bits)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["in_range", "segment", "first", "n_tokens", "doc_ids", "counts", "codes"],
            )

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                held.append(coder.ids(text.as_py()) + end)
                names.append(name.as_py())
                counts.append(len(held[-1]) // 4)
                tokens += counts[-1]
                if tokens >= segment_tokens:
                    yield close()
                    number, first = number + 1, first + tokens
                    names, counts, held, tokens = [], [], [], 0
        if names:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    spark = docs.sparkSession
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = coded.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(segments, SEGMENTS)
    coded.write.option("compression", "none").parquet(f"{path}/segments")
    totals = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("in_range").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("in_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases.write.parquet(f"{path}/ranges")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    bases = spark.read.schema("in_range int, base long").parquet(f"{path}/ranges")
    # One row for each range of the writing shuffle.
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(F.broadcast(bases), "in_range")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token set: doc_id, start (ids before it), n_tokens, ids (unsigned 32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, counts, packed, at = (batch.column(c)[k] for c in range(4))
                counts, codes = np.array(counts.as_py(), np.int64), Codes(packed.as_py())
                ends = np.cumsum(counts)
                ids = [codes.slice(b, e).tobytes() for b, e in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.as_py(), pa.int64()),
                        pa.array(at.as_py() + ends - counts),
                        pa.array(counts),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    stored = _segments(spark, path).select("doc_ids", "counts", "codes", (F.col("base") + F.col("first")).alias("at"))
    return stored.mapInArrow(decode, DOCUMENTS)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, bucket: int = SEGMENT_TOKENS) -> DataFrame:
    """The token at each place of ``positions`` (column position): position, token; places outside are left out.

    Places and segments meet in buckets of ``bucket`` tokens, at most so many places each; only the
    asked ids are read from the codes.
    """

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for places, start, packed in zip(frame["places"], frame["start"], frame["codes"]):
                codes = Codes(packed)
                inside = [int(p) for p in places if 0 <= p - start < len(codes)]
                yield pd.DataFrame({"position": inside, "token": [codes.at(p - start) for p in inside]}, dtype="int64")

    start = F.col("base") + F.col("first")
    stored = _segments(spark, path).where("n_tokens > 0").select(
        start.alias("start"),
        "codes",
        F.explode(F.sequence(F.floor(start / bucket), F.floor((start + F.col("n_tokens") - 1) / bucket))).alias("bucket"),
    )
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.groupBy(F.floor(F.col("position") / bucket).alias("bucket")).agg(F.collect_list("position").alias("places"))
    return stored.join(asked, "bucket").select("places", "start", "codes").mapInPandas(look, "position long, token long")

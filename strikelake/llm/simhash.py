"""SimHash near-duplicates: a byte-position inverted index of 64-bit fingerprints.

Two fingerprints that differ in at most two bits share at least six of their eight positional
bytes. One list for each positional byte would hold 1/256 of all fingerprints, and pairs tallied
over such lists grow with the square of the corpus. So the index is keyed on six positional bytes
together: a pair meets in one of the 28 lists exactly if its tally reaches the guaranteed six, in
seven if it is seven, in all if the fingerprints are equal. What differs inside a list is sixteen
bits, so a list holds at most 65,536 fingerprints however many documents there are; they are
verified by looking the 136 close values of each up, never by pairing all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .encode import Encoder

#: Sixteen-bit numbers with one or two bits set.
CLOSE = np.array(
    [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], np.int64
)
SHIFTS = np.arange(8, dtype=np.uint8)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number: bit k is 1 if set in over half the hashes
    of its ``shingle``-word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[b:e], seed) for b, e in zip(begins, (ends[shingle - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.stack([np.count_nonzero(some >> s & 1, axis=0) for s in SHIFTS], axis=1).reshape(64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_of(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Column of fingerprints (long) of a text column."""

    @pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        Encoder.release()
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return marked(text.cast("string").cast("binary"))


def list_links(values: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For the different 16-bit ``values`` of one list: each value and the least one it is linked to."""
    values = np.unique(values).astype(np.int64)
    present = np.zeros(1 << 16, bool)
    present[values] = True
    close = CLOSE if most == 2 else CLOSE[:16]
    label = np.arange(1 << 16)
    while True:
        before = label[values]
        least = before.copy()
        for flip in close:
            other = values ^ flip
            np.minimum(least, np.where(present[other], label[other], least), out=least)
        label[values] = least
        label[values] = label[label[values]]
        if (label[values] == before).all():
            return values, before


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Links among the different fingerprints of ``prints`` (column fingerprint): a, b with a linked to b.

    Every fingerprint within ``most`` (1 or 2) bits of another is joined to it by a path of these
    links, and no others are. A list gives one link a member at most, to its smallest relative.
    """
    lists = [sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 6)]
    masks = F.array(*[F.struct(F.lit(k).alias("list"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for k, m in enumerate(lists)])
    posted = prints.select(F.col("fingerprint"), F.explode(masks).alias("m")).select(
        F.col("m.list").alias("list"), F.col("fingerprint").bitwiseAND(F.col("m.mask")).alias("kept"), "fingerprint"
    )
    met = posted.groupBy("list", "kept").agg(F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1)

    places = {k: [p for p in range(8) if not lists[k] >> 8 * p & 0xFF] for k in range(len(lists))}

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
            for k, kept, members in zip(frame["list"], frame["kept"], frame["members"]):
                low, high = (np.uint64(8 * p) for p in places[k])
                bits = np.asarray(members, np.int64).view(np.uint64)
                small = (bits >> low & np.uint64(0xFF)) | (bits >> high & np.uint64(0xFF)) << np.uint64(8)
                if len(small) == 2 and int(small[0] ^ small[1]).bit_count() > most:
                    continue
                ends = np.stack(list_links(small, most), axis=1).astype(np.uint64)
                ends = ends[ends[:, 0] != ends[:, 1]]
                full = (ends & np.uint64(0xFF)) << low | (ends >> np.uint64(8)) << high | np.uint64(int(kept) & (2**64 - 1))
                out.append(full.view(np.int64))
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return met.mapInPandas(verified, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b, a <> b): node, root (its least node), for nodes with edges.

    Alternates two star steps until nothing changes: each node hangs its larger neighbours, then its
    smaller ones, on the least node it knows. Only minima are gathered for a node, never its
    neighbours; each round is written to the shared folder.
    """
    known = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = known.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(prints: DataFrame, most: int = 2) -> DataFrame:
    """Fingerprints with a link of ``prints`` (fingerprint): node, root of its class. The rest stand alone."""
    return cut_lineage(components(links(prints.select("fingerprint").distinct(), most)))


def near_duplicates(docs: DataFrame, most: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Fingerprint and near-duplicate class of every row of ``docs`` (doc_id, text).

    Returns doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links of
    at most ``most`` differing bits, the row itself included. Equal fingerprints are linked; so are
    all texts without words, null among them. Rows without an id take part; a class of such rows
    alone has a null component_id.
    """
    rows = cut_lineage(docs.select("doc_id", fingerprint_of(F.col("text"), shingle, seed).alias("fingerprint")))
    least = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    linked = classes(least, most)
    rooted = least.join(linked, least["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "doc_id", F.coalesce("root", "fingerprint").alias("root")
    )
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(first, "root").select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row every row was read from, as a struct ``at``; rows of other origin are written first."""
    try:
        origin = docs.metadataColumn("_metadata")
        return docs.withColumn("at", F.struct(origin["file_path"].alias("file"), origin["row_index"].alias("row")))
    except AnalysisException:
        return identified(cut_lineage(docs))


def one_of_each(docs: DataFrame, most: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, with all its columns: the smallest doc_id, null last.

    Classes are settled on narrow rows that name the file and row of each document; of rows with the
    same id the first so named stays. The documents are then read once more and meet the names of
    those that stay by hash join, so neither their number nor their length changes the plan. An empty
    table gives no rows.
    """
    columns = [F.col(f"doc.{c}") for c in map("`{}`".format, docs.columns)]
    known = identified(docs.select(F.struct("*").alias("doc")))
    numbered = cut_lineage(
        known.select("at", F.col("doc.doc_id").alias("doc_id"), fingerprint_of(F.col("doc.text"), shingle, seed).alias("fingerprint"))
    )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")
    least = cut_lineage(numbered.groupBy("fingerprint").agg(F.min(rank).alias("rank")))
    linked = classes(least, most)
    rooted = least.join(linked, least["fingerprint"] == linked["node"], "left")
    kept = rooted.groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("rank").alias("rank"))
    kept = cut_lineage(kept.select("rank.at"))
    return known.join(kept.hint("shuffle_hash"), "at", "left_semi").select(*columns)

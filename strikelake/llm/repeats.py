"""Repeated byte strings over all texts, from sparse suffix arrays and their common-prefix interval trees.

Suffixes are taken at anchors only: of every window of ``length`` bytes, the place of its least hashed
``gram``-byte string. Two equal windows have their anchor at the same place, so an anchor with the
bytes its windows cover (its context) shows every repeat of at least ``length`` bytes; a longer repeat
shows as a chain of overlapping ones. Anchors whose string occurs once are dropped before anything but
their hash is moved. Equal contexts (by a 128-bit hash) are one member with a weight. Only members
that differ are compared: those of one anchor string are a stretch of the suffix array, sorted by the
bytes behind the anchor. A stack scan over neighbours' common prefixes gives its interval tree; in each
interval a second scan, over the bytes before the anchors, finds the groups that end in different
bytes on both sides: maximal repeats with all their members.

An anchor string with more than ``most`` different contexts is not given to one task: its windows are
compared as such, each by its own hash, which finds the same repeats.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

LENGTH, GRAM, MOST = 200, 24, 2000
#: Windows looked at together in a long text.
BLOCK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every ``gram`` bytes of ``data`` (uint8), by doubling."""
    power, size = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    power ^= power >> np.uint64(32)
    out, have = None, 0
    while gram:
        if gram & 1:
            if out is None:
                out, have = power, size
            else:
                n = len(data) - (have + size) + 1
                out = out[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + power[have : have + n]
                have += size
        gram >>= 1
        if gram:
            n = len(power) - size
            power = power[:n] * np.uint64(pow(_FACTOR, size, 1 << 64)) + power[size:]
            size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    n, least, size = len(values) - width + 1, values, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> np.ndarray:
    """Anchors of ``text``: rows of first window, last window, anchor place, hash (as int64)."""
    data, parts = np.frombuffer(text, np.uint8), [np.zeros((0, 4), np.int64)]
    for at in range(0, len(data) - length + 1, block):
        hashes = gram_hashes(data[at : at + block + length - 1], gram)
        # The leftmost place of the least hash: its upper half, then the place.
        marked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        least = window_least(marked, length - gram + 1)
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(least) - 1]))
        place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts.append(np.stack([first + at, last + at, place + at, hashes[place].view(np.int64)], axis=1))
    return np.concatenate(parts)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def prefix_intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals (depth, first, last) of the common-prefix tree, inner ones first.

    ``shared[i]`` is the common prefix of entries i and i + 1 of a sorted array.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        left = i
        while stack and stack[-1][0] > depth:
            deep, left = stack.pop()
            yield deep, left, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def maximal_groups(before: list[bytes], behind: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats among different contexts of one anchor: bytes before it, bytes from it on, members.

    ``before`` holds each context's bytes before the anchor from the last to the first, ``behind``
    those from the anchor on, in sorted order. Each group shares at least ``length`` bytes, its
    members differ in both next bytes (or end there), and no two groups are equal.
    """
    shared = [common(a, b) for a, b in zip(behind, behind[1:])]
    order = sorted(range(len(before)), key=before.__getitem__)
    rank = {member: r for r, member in enumerate(order)}
    beside = [common(before[a], before[b]) for a, b in zip(order, order[1:])]
    longest = max(map(len, before), default=0)
    for depth, lo, hi in prefix_intervals(shared):
        if depth + longest < length:
            continue
        if hi - lo + 1 == len(order):
            members, near = order, beside
        else:
            members = sorted(range(lo, hi + 1), key=rank.__getitem__)
            near = [common(before[a], before[b]) for a, b in zip(members, members[1:])]
        # Where the interval's children begin: a group inside one child goes on to the right.
        children = [i + 1 for i in range(lo, hi) if shared[i] == depth]
        for left, b, e in prefix_intervals(near):
            if left + depth < length:
                continue
            group = members[b : e + 1]
            child = bisect_right(children, group[0])
            if any(bisect_right(children, m) != child for m in group):
                yield left, depth, group


def stored_texts(docs: DataFrame) -> DataFrame:
    """The different texts of ``docs``, written bucketed by their key: text_key (md5), text, copies.

    What is joined to the texts later moves to the buckets; the texts move once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = texts.write.bucketBy(n, "text_key").option("path", f"{shared_folder(spark)}/{name}")
    writer.option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _per_text(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make(bytes, number of the row in the batch, batch)`` gives arrays of equal length, one for each column."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in (make(text.as_py().encode(), k, batch) for k, text in enumerate(batch.column("text"))) if x is not None]
            if found:
                columns = [pa.concat_arrays(list(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(read, schema)


def _repeated(value: pa.Scalar, n: int) -> pa.Array:
    return pa.repeat(value, n)


def _taken(table: pa.Table, column: str, rows: list[int]) -> pa.Array:
    return table.column(column).combine_chunks().take(pa.array(rows, pa.int64()))


def repeated_anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Anchors of ``texts`` whose string occurs more than once: anchor, text_key, first, last, place."""
    weighed = texts.where(F.octet_length("text") >= length).select("text_key", "text", F.least("copies", F.lit(2)).alias("weight"))

    def listed(text: bytes, k: int, batch: pa.RecordBatch) -> list[pa.Array]:
        found = anchors(text, length, gram)
        n = len(found)
        ints = [pa.array(found[:, c].astype(np.int32)) for c in range(3)]
        return [pa.array(found[:, 3]), _repeated(batch.column("text_key")[k], n), *ints, _repeated(batch.column("weight")[k], n)]

    every = cut_lineage(_per_text(weighed, listed, "anchor long, text_key binary, first int, last int, place int, weight long"))
    often = cut_lineage(every.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"))
    return every.drop("weight").join(often, "anchor")


def contexts_of(texts: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts of the anchors ``found``: anchor, context (128-bit hash), text_key, first, last, place, weight."""
    mine = found.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "first", "last", "place")).alias("found"))
    rows = texts.join(mine, "text_key").select("text_key", "text", F.least("copies", F.lit(2)).alias("weight"), "found")

    def cut(text: bytes, k: int, batch: pa.RecordBatch) -> list[pa.Array]:
        some = batch.column("found")[k].values
        first, last = (some.field(c).to_numpy() for c in ("first", "last"))
        marks = [xxhash.xxh3_128_digest(text[b : e + length]) for b, e in zip(first.tolist(), last.tolist())]
        n = len(some)
        return [
            some.field("anchor"), pa.array(marks, pa.binary()), _repeated(batch.column("text_key")[k], n),
            some.field("first"), some.field("last"), some.field("place"), _repeated(batch.column("weight")[k], n),
        ]

    return _per_text(rows, cut, "anchor long, context binary, text_key binary, first int, last int, place int, weight long")


class Repeats:
    """The repeats of at least ``length`` bytes among the texts of ``docs`` (text); tables are written as they are made.

    ``equal``: occurrences of contexts that occur more than once (anchor, context, text_key, first,
    last). ``apart``: the contexts that share an anchor with others, with their bytes; ``groups()`` are
    the maximal repeats among them. ``windows``: repeated windows of anchors with more than ``most``
    contexts (window, start, anchor, context, weight, text_key).
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST):
        if not 0 < gram <= length:
            raise ValueError("an anchor string is part of a window")
        self.length, self.gram, self.most = length, gram, most
        self.texts = stored_texts(docs)
        self.contexts = cut_lineage(contexts_of(self.texts, repeated_anchors(self.texts, length, gram), length))
        one = F.min(F.struct("text_key", "first", "last", "place")).alias("one")
        self.members = cut_lineage(self.contexts.groupBy("anchor", "context").agg(F.sum("weight").alias("weight"), one))
        often = self.members.where("weight > 1").select("anchor", "context")
        self.equal = self.contexts.join(often, ["anchor", "context"]).select("anchor", "context", "text_key", "first", "last")
        several = self.members.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        apart = self._with_bytes(self.members.join(several, "anchor").select("*", "one.*").drop("one"))
        self.apart = cut_lineage(apart)
        self.windows = self._windows(self.apart.where(F.col("n") > most))

    def _with_bytes(self, members: DataFrame) -> DataFrame:
        """``members`` with the bytes before (from the last to the first) and behind their anchors."""
        length, names = self.length, ["anchor", "context", "weight", "n", "first", "last", "place"]
        mine = members.groupBy("text_key").agg(F.collect_list(F.struct(*names)).alias("found"))
        rows = self.texts.join(mine, "text_key").select("text_key", "text", "found")

        def cut(text: bytes, k: int, batch: pa.RecordBatch) -> list[pa.Array]:
            some = batch.column("found")[k].values
            first, last, place = (some.field(c).to_pylist() for c in ("first", "last", "place"))
            before = [text[b:p][::-1] for b, p in zip(first, place)]
            behind = [text[p : e + length] for p, e in zip(place, last)]
            kept = [some.field(c) for c in ("anchor", "context", "weight", "n", "place")]
            return [*kept, _repeated(batch.column("text_key")[k], len(some)), pa.array(before, pa.binary()), pa.array(behind, pa.binary())]

        return _per_text(rows, cut, "anchor long, context binary, weight long, n long, place int, text_key binary, before binary, behind binary")

    def _by_anchor(self, make: Callable[[pa.Table, Iterator], pa.RecordBatch | None], schema: str) -> DataFrame:
        """``make(members of an anchor, their maximal groups)`` for every anchor, in the suffix array's order."""
        length = self.length

        def found(rest: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(rest)
            before, behind = (table.column(c).to_pylist() for c in ("before", "behind"))
            return make(table, maximal_groups(before, behind, length))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: list[pa.RecordBatch] = []
            for batch in batches:
                key = batch.column("anchor")
                new = pc.indices_nonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))).to_pylist() if len(key) else []
                starts = [0, *[i + 1 for i in new]]
                for b, e in zip(starts, [*starts[1:], len(key)]):
                    if e == b:
                        continue
                    if rest and rest[0].column("anchor")[0] != key[b]:
                        done = found(rest)
                        rest = []
                        if done is not None:
                            yield done
                    rest.append(batch.slice(b, e - b))
            if rest and (done := found(rest)) is not None:
                yield done

        few = self.apart.where(F.col("n") <= self.most).drop("n")
        return few.repartition("anchor").sortWithinPartitions("anchor", "behind").mapInArrow(scan, schema)

    def groups(self) -> DataFrame:
        """Maximal repeats among contexts that differ, one row a member: anchor, context, number, n_bytes, start (of one occurrence)."""

        def each(table: pa.Table, groups: Iterator) -> pa.RecordBatch | None:
            place, rows, numbers, sizes, starts = table.column("place").to_pylist(), [], [], [], []
            for number, (left, right, group) in enumerate(groups):
                rows += group
                numbers += [number] * len(group)
                sizes += [left + right] * len(group)
                starts += [place[m] - left for m in group]
            if not rows:
                return None
            kept = [_taken(table, c, rows) for c in ("anchor", "context")]
            more = [pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(starts, pa.int32())]
            return pa.RecordBatch.from_arrays([*kept, *more], names=["anchor", "context", "number", "n_bytes", "start"])

        return self._by_anchor(each, "anchor long, context binary, number long, n_bytes int, start int")

    def _apart_spans(self) -> DataFrame:
        """Stretches that the maximal groups cover in members that occur once, joined for each: text_key, start, end."""

        def each(table: pa.Table, groups: Iterator) -> pa.RecordBatch | None:
            place, weight = (table.column(c).to_pylist() for c in ("place", "weight"))
            # All stretches of a member hold its anchor, so together they are one.
            lefts, rights = [0] * len(place), [0] * len(place)
            for left, right, group in groups:
                for m in group:
                    lefts[m] = max(lefts[m], left)
                    rights[m] = max(rights[m], right)
            rows = [m for m, right in enumerate(rights) if right and weight[m] == 1]
            if not rows:
                return None
            starts, ends = [place[m] - lefts[m] for m in rows], [place[m] + rights[m] for m in rows]
            return pa.RecordBatch.from_arrays(
                [_taken(table, "text_key", rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["text_key", "start", "end"]
            )

        return self._by_anchor(each, "text_key binary, start int, end int")

    def _windows(self, apart: DataFrame) -> DataFrame:
        length = self.length

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    left = batch.column("before")[k].as_py()[::-1]
                    whole, start = left + batch.column("behind")[k].as_py(), batch.column("place")[k].as_py() - len(left)
                    n = len(whole) - length + 1
                    marks = [xxhash.xxh3_128_digest(whole[i : i + length]) for i in range(n)]
                    kept = [_repeated(batch.column(c)[k], n) for c in names]
                    places = pa.array(np.arange(start, start + n, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), places, *kept], names=["window", "start", *names])

        names = ["anchor", "context", "weight", "text_key"]
        every = apart.mapInArrow(each, "window binary, start int, anchor long, context binary, weight long, text_key binary")
        often = cut_lineage(every.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window"))
        return every.join(often, "window")

    def spans(self) -> DataFrame:
        """Repeated stretches of each text that occurs once, not yet joined: text_key, start, end."""
        length = F.lit(self.length)
        return (
            self.equal.select("text_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
            .unionByName(self._apart_spans())
            .unionByName(self.windows.where("weight = 1").select("text_key", "start", (F.col("start") + length).alias("end")))
        )

    def occurrences(self) -> DataFrame:
        """Maximal repeat groups with all their occurrences: repeat, n_bytes, text_key, start.

        Groups are maximal as far as one anchor's windows reach.
        """
        members = self.members.select("anchor", "context", F.col("one.first").alias("one_first"))
        at = self.contexts.select("anchor", "context", F.col("text_key").alias("at_key"), F.col("first").alias("at_first"))
        apart = self.groups().select("anchor", "context", F.concat_ws("-", F.hex("anchor"), "number").alias("repeat"), "n_bytes", "start")
        hot = self.windows.select("anchor", "context", F.hex("window").alias("repeat"), F.lit(self.length).alias("n_bytes"), "start")
        mine = apart.unionByName(hot).join(members, ["anchor", "context"]).join(at, ["anchor", "context"])
        moved = (F.col("start") + F.col("at_first") - F.col("one_first")).cast("int")
        equal = self.equal.select(
            F.hex("context").alias("repeat"), (F.col("last") - F.col("first") + self.length).alias("n_bytes"), "text_key", F.col("first").alias("start")
        )
        return mine.select("repeat", "n_bytes", F.col("at_key").alias("text_key"), moved.alias("start")).unionByName(equal)

    def kept(self) -> DataFrame:
        """Every different text without its repeats: text_key, n_bytes, n_removed, n_spans, kept (binary)."""
        length = self.length
        # The stretches of one text, at most three for each of its bytes.
        mine = self.spans().distinct().groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
        rows = self.texts.join(mine, "text_key", "left").select("text_key", "text", "copies", "found")

        def cut(text: bytes, k: int, batch: pa.RecordBatch) -> list[pa.Array]:
            found = batch.column("found")[k]
            if batch.column("copies")[k].as_py() > 1 and len(text) >= length:
                runs = [(0, len(text))]
            elif not found.is_valid:
                runs = []
            else:
                runs = joined(found.values.field("start").to_numpy(), found.values.field("end").to_numpy())
            parts, at = [], 0
            for b, e in runs:
                parts.append(text[at:b])
                at = e
            rest = b"".join([*parts, text[at:]])
            numbers = [len(text), len(text) - len(rest), len(runs)]
            return [pa.array([batch.column("text_key")[k].as_py()], pa.binary()), *[pa.array([n], pa.int64()) for n in numbers], pa.array([rest], pa.binary())]

        return _per_text(rows, cut, "text_key binary, n_bytes long, n_removed long, n_spans long, kept binary")


def joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by stretches that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[new].tolist(), reach[last].tolist()))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without the bytes of any ``length``-byte string that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes
    left). "Elsewhere" is any other place of any text, the same one included; strings are judged on
    the input. Copies of a text of at least ``length`` bytes so lose all their bytes. Null texts are
    empty, rows without an id are rows, an empty table gives no rows; other columns are not read.
    ``Repeats`` has the bytes left and the repeats themselves.
    """
    kept = Repeats(docs, length, gram, most).kept()
    digests = kept.select("text_key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    return rows.join(cut_lineage(digests), "text_key").drop("text_key")

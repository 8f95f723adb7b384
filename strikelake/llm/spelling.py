"""Spelling variants: words one edit apart, found among the sorted rotations of marked words.

A word's end is marked and every rotation of it is taken. The rotation that starts behind a character
has that character last; without it, it is the prefix that all words share which differ from this one
in that character alone, and it is the whole rotation of the word that lacks the character. So
replacements and indels meet in one group of equal prefixes. A group has at most one member for each
letter that can be skipped and one whole rotation: its size is bounded by the alphabet, whatever the
corpus, so no group can grow hot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The letters of a word, and the mark of its end, which is none of them.
LETTERS = "[A-Za-zÀ-ÿ]"
END = "$"




def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, typo_every: int | None = None, held: int = 200_000) -> DataFrame:
    """Words of all whole texts of ``docs`` (doc_id, text) with their number of occurrences: word, n.

    Words are maximal runs of ``LETTERS`` with A-Z lower-cased, of at least ``min_length`` code
    points and ``min_count`` occurrences. With ``typo_every`` a run whose crc32 with its document's
    id is divisible by it first loses one letter, so that the result's spelling is tested on known
    errors. A null text has no words, a null id stands as empty text, an empty table gives no rows;
    other columns are not read. A task holds at most ``held`` different words and one document's.
    """
    pattern = re.compile(f"{LETTERS}{{{min_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(tally.keys()), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                # Lower-casing bytes changes A-Z alone.
                runs = Counter(pattern.findall(text.as_py().encode().lower().decode()))
                start = zlib.crc32(name.as_py().encode() + b":") if typo_every else 0
                for run, n in runs.items():
                    if typo_every:
                        code = zlib.crc32(run.encode(), start)
                        if code % typo_every == 0:
                            at = code % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_length:
                                continue
                    tally[run] += n
                if len(tally) > held:
                    yield given()
                    tally.clear()
        if tally:
            yield given()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string")).where("text is not null")
    counts = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """Rotations of the marked words (word, n): key, skipped, first, word, n.

    With ``skipped``, key is the rotation that starts behind that character, without it; ``first``
    says that the character does not repeat the one before it, so that of the places whose removal
    gives one word only one counts. Without ``skipped``, key is a whole rotation.
    """
    word, n = F.col("word"), F.length("word")

    def from_(i: Column, skip: int) -> Column:
        return F.concat(F.substr(word, i + skip), F.lit(END), F.substr(word, F.lit(1), i - 1))

    def skipping(i: Column) -> Column:
        here = F.substr(word, i, F.lit(1))
        first = (i == 1) | (here != F.substr(word, i - 1, F.lit(1)))
        return F.struct(from_(i, 1).alias("key"), here.alias("skipped"), first.alias("first"))

    def whole(i: Column) -> Column:
        return F.struct(from_(i, 0).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("first"))

    turns = F.concat(F.transform(F.sequence(F.lit(1), n), skipping), F.transform(F.sequence(F.lit(1), n + 1), whole))
    return words.where(n > 0).select("word", "n", F.explode(turns).alias("r")).select("r.*", "word", "n")


def group_neighbours(members: list[tuple[str | None, bool, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Of one key's members (skipped, first, word, n): word, number of near words, the best one's n and word.

    Best is the one with the largest n, of these the smallest. Words without a near one are left out.
    """
    ranked = sorted(members, key=lambda m: (-m[3], m[2]))
    skips = sum(m[0] is not None for m in members)
    firsts = sum(m[0] is not None and m[1] for m in members)
    wholes = len(members) - skips
    for k, (skipped, first, word, _) in enumerate(ranked):
        near = firsts if skipped is None else skips - 1 + (wholes if first else 0)
        if not near:
            continue
        # A member stops at the first other one it is near to; those it passes over are its own
        # entry, one whole rotation or skips of a repeated letter.
        for j, other in enumerate(ranked):
            if j != k and ((skipped is not None and other[0] is not None) or (first and other[1] and (skipped is None) != (other[0] is None))):
                yield word, near, other[3], other[2]
                break


def neighbours(words: DataFrame) -> DataFrame:
    """Near words of ``words`` (word, n): word, n_near, form_n, form (the near word of largest n, ties to the smallest).

    Near is one inserted, deleted or replaced code point. The sorted rotations are read in order,
    group by group; words without near ones are left out.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(table: pa.Table, starts: list[int], ends: list[int]) -> pa.RecordBatch:
            out = []
            for b, e in zip(starts, ends):
                some = table.slice(b, e - b)
                out += group_neighbours(list(zip(*[some.column(c).to_pylist() for c in range(1, 5)])))
            columns = zip(*out) if out else ([], [], [], [])
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "best_n", "best"])

        def runs(table: pa.Table) -> tuple[list[int], list[int]]:
            key = table.column(0)
            new = pc.indices_nonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))).to_pylist()
            starts = [0, *[i + 1 for i in new]]
            return starts, [*starts[1:], len(key)]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            starts, ends = runs(table)
            # The last group may go on in the next batch.
            rest = table.slice(starts[-1])
            yield _several(table, starts[:-1], ends[:-1], found)
        if rest is not None:
            yield _several(rest, [0], [rest.num_rows], found)

    turned = rotations(words).select("key", "skipped", "first", "word", "n")
    pairs = turned.repartition("key").sortWithinPartitions("key").mapInArrow(scanned, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    together = pairs.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return together.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _several(table: pa.Table, starts: list[int], ends: list[int], found) -> pa.RecordBatch:
    kept = [(b, e) for b, e in zip(starts, ends) if e - b > 1]
    return found(table, [b for b, _ in kept], [e for _, e in kept])


def roots(links: DataFrame) -> DataFrame:
    """Last word on the way of ``links`` (word, form, without cycles) from each word: word, root.

    Each round replaces a word's pointer by its target's, so ways halve; rounds are written.
    """
    known = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        target = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(known.join(target, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Form and root of each of ``words`` (word, n; words differ): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order), if that n is at
    least ``ratio`` times its own, else null; ``root`` is the last word on the way over forms, the
    word itself if it has none. n_near counts its near words, 0 if none. Counts at least double on
    the way with ratio 2, so ways are short and have no cycles. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 can give cycles")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    near = words.join(neighbours(words), "word", "left")
    holds = F.col("form_n") >= ratio * F.col("n")
    judged = cut_lineage(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(holds, F.col("form")).alias("form"),
            F.when(holds, F.col("form_n")).alias("form_n"),
        )
    )
    found = judged.join(roots(judged.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

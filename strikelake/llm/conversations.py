"""Conversation structure repair: the cheapest edits, from block tables of cost vectors.

The roles kept must read ``(s?(ua)+)?`` by their initials. An edit path walks an automaton of four
states, so what lies ahead of a row is a vector of four costs. Less their minimum these vectors are
few: insertions and deletions bound how far the states can lie apart. Following the Four Russians, the
next vector and its added cost are tabled once for every vector and every block of ``BLOCK`` rows, and
a conversation is read block by block, one look-up each, from its end. Of equal costs the audit that
is least in ASCII order is asked, which is settled at the first edit that differs; so the costs are
those still to come, and the tracing goes forward, expanding each block backward from the
vector kept at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .shared import in_order

#: The costs of edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. A new u or a is due as follows, and leads to:
DUE, NEXT = "uuau", (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
#: Cost still to come at the end of a conversation, insertions included.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: A row's symbol: its initial's place here (the last for any other), plus 4 if it is truncated; 8 if it must go.
INITIALS = "sua"
MUST_GO, SYMBOLS, BLOCK = 8, 9, 4


def _kept(symbol: int, state: int) -> int | None:
    """State after keeping a row, or None."""
    initial = symbol % 4
    if initial == 0:
        return 1 if state == 0 else None
    return NEXT[state] if initial < 3 and INITIALS[initial] == DUE[state] else None


def ahead(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to come before a row, of those ``after`` it."""
    out = []
    for state in range(4):
        least = DELETE + after[state]
        if symbol != MUST_GO:
            extra = TRUNCATED if symbol >= 4 else 0
            least = min(least, REROLE + extra + after[NEXT[state]])
            to = _kept(symbol, state)
            if to is not None:
                least = min(least, extra + after[to])
        out.append(least)
    out[2] = min(out[2], INSERT + out[3])
    out[3] = min(out[3], INSERT + out[2])
    return tuple(min(c, INSERT + out[2]) if state < 2 else c for state, c in enumerate(out))


class Tables:
    """Transitions of all cost vectors that occur, by one symbol and by blocks of ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.step, self.added = [AT_END], [], []
        numbers = {AT_END: 0}
        for vector in self.vectors:  # grows until no new vector is met
            costs = [ahead(s, vector) for s in range(SYMBOLS)]
            normal = [tuple(c - min(x) for c in x) for x in costs]
            for x in normal:
                if x not in numbers:
                    numbers[x] = len(self.vectors)
                    self.vectors.append(x)
            self.step.append([numbers[x] for x in normal])
            self.added.append([min(x) for x in costs])
        one, plus = np.array(self.step), np.array(self.added)
        to, cost = one, plus
        for _ in range(block - 1):
            # A symbol before the block: the block first, then the symbol from where it led.
            to, cost = (
                one[to].transpose(0, 2, 1).reshape(len(one), -1),
                (cost[:, :, None] + plus[to]).transpose(0, 2, 1).reshape(len(one), -1),
            )
        self.block_step, self.block_added = to.tolist(), cost.tolist()
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _expanded(self, symbols: bytes, end: int, state: int) -> tuple[str, int]:
        """Edits and last state of a block entered in ``state``, with vector ``end`` behind it."""
        behind = [end]
        for s in reversed(symbols):
            behind.append(self.step[behind[-1]][s])
        behind.reverse()
        edits = []
        for at, s in enumerate(symbols):
            here, after, added = self.vectors[behind[at]], self.vectors[behind[at + 1]], self.added[behind[at + 1]][s]
            while True:
                # In ASCII order: delete, insert, keep, rerole.
                if DELETE + after[state] == added + here[state]:
                    edits.append("D")
                    break
                if INSERT + here[NEXT[state]] == here[state]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                to, extra = _kept(s, state) if s != MUST_GO else None, TRUNCATED if s >= 4 else 0
                keeps = to is not None and extra + after[to] == added + here[state]
                edits.append("K" if keeps else "R")
                state = to if keeps else NEXT[state]
                break
        return "".join(edits), state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and the ASCII-least audit of one conversation's ``symbols``."""
        head = len(symbols) % self.block
        codes = (np.frombuffer(symbols, np.uint8)[head:].reshape(-1, self.block) @ self.weights).tolist()
        vector, cost, ends = 0, 0, []
        for code in reversed(codes):
            ends.append(vector)
            cost += self.block_added[vector][code]
            vector = self.block_step[vector][code]
        edits, at, begin = [], vector, vector
        for s in reversed(symbols[:head]):
            cost += self.added[begin][s]
            begin = self.step[begin][s]
        first, state = self._expanded(symbols[:head], at, 0)
        edits.append(first)
        for k, (code, end) in enumerate(zip(codes, reversed(ends))):
            known = self.traced.get((end, code, state))
            if known is None:
                known = self._expanded(symbols[head + k * self.block : head + (k + 1) * self.block], end, state)
                self.traced[end, code, state] = known
            edits.append(known[0])
            state = known[1]
        edits.append("I" * (AT_END[state] // INSERT))
        return cost + self.vectors[begin][0], "".join(edits)


@cache
def tables() -> Tables:
    return Tables()


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows, from the edits and the rows (role, text) in order."""
    state = 0
    for edit in audit:
        if edit == "I":
            yield ROLES[DUE[state]], ""
            state = NEXT[state]
            continue
        role, text = next(rows)
        if edit == "K":
            yield role, text
            state = 1 if role[:1] == "s" else NEXT[state]
        elif edit == "R":
            yield ROLES[DUE[state]], text
            state = NEXT[state]


def damaged(convs: DataFrame) -> DataFrame:
    """``convs`` with known faults, decided by the crc32 of ``conv_id:turn`` modulo 20: conv_id, turn, role, text, there.

    0 drops the row (``there`` is false), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it,
    4 gives it the role user. Nulls stand as one space, except in the columns conv_id and turn.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = convs.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, r"[.!?]", "")).otherwise(text).alias("text"),
        (code != 0).alias("there"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _ordered(convs: DataFrame) -> DataFrame:
    """Rows that are there, with their place in the order of conversation, turn, role and text hash."""
    there = F.coalesce("there", F.lit(True)) if "there" in convs.columns else F.lit(True)
    rows = convs.where(there).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("mark", F.md5(F.col("text").cast("binary")))
    return in_order(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")])


def _audits(ordered: DataFrame, every: DataFrame, chunk: int) -> DataFrame:
    """Faults, cost and audit of each conversation of ``ordered`` and each other id of ``every``."""
    keys = ["conv_id", "role", "mark"]
    narrow = ordered.select(
        *keys,
        "position",
        "turn",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # A fault's first row is found by an aggregate, so a text that fills a conversation is no hot window.
    firsts = narrow.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min("position").alias("first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    seen = ~F.col("blank") & (F.col("position") > F.col("first"))
    cut = ~F.col("blank") & ~seen & F.col("cut")
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    # An empty role is found at the first place.
    initial = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(len(INITIALS))
    fault = F.when(F.col("blank") | seen, 2).when(cut, 1).otherwise(0)
    marked = narrow.join(firsts, same).select(
        "conv_id",
        "position",
        F.struct("position", F.chr((97 + initial + 4 * fault).cast("long")).alias("symbol")).alias("at"),
        F.col("blank").cast("long").alias("blank"),
        seen.cast("long").alias("duplicate"),
        cut.cast("long").alias("truncated"),
    )
    # Symbols gather in bounded stretches of the order first. All of one conversation are as
    # many characters as its audit, which is one value of the result.
    faults = ["blank", "duplicate", "truncated"]
    stretches = marked.groupBy("conv_id", F.floor(F.col("position") / chunk).alias("stretch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["symbol"]), "").alias("symbols"),
        *[F.sum(c).alias(c) for c in faults],
    )
    turns = narrow.select("conv_id", "turn").distinct()
    parts = stretches.unionByName(turns, allowMissingColumns=True).unionByName(every.select("conv_id").distinct(), allowMissingColumns=True)
    joined = F.array_sort(F.collect_list(F.when(F.col("stretch").isNotNull(), F.struct("stretch", "symbols"))))
    whole = parts.groupBy("conv_id").agg(
        F.array_join(F.transform(joined, lambda x: x["symbols"]), "").alias("symbols"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in faults],
    )

    @pandas_udf("cost long, audit string, illegal long")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for symbols in batch:
                codes = np.frombuffer(symbols.encode(), np.uint8) - 97
                kinds = codes % 4
                pairs = kinds[:-1] * 4 + kinds[1:]
                legal = np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
                found.append((*tables().repair(np.minimum(codes, MUST_GO).astype(np.uint8).tobytes()), int(np.count_nonzero(~legal))))
            yield pd.DataFrame(found, columns=["cost", "audit", "illegal"])

    return whole.withColumn("j", judged("symbols")).select("conv_id", "gaps", *faults, "j.illegal", "j.cost", "j.audit")


def _streamed(ordered: DataFrame, audits: DataFrame, emit, schema: T.StructType, kept: list[str]) -> DataFrame:
    """Each conversation's audit and rows, read in order by one task that holds the audit and a batch of rows.

    ``emit(values, repaired)`` gets the audit row's ``kept`` values and the repaired rows as a stream
    and yields result rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = rows(batches)
        pending = next(stream, None)
        out: list[tuple] = []
        held = 0

        def mine() -> Iterator[tuple[str, str]]:
            nonlocal pending
            while (pending := next(stream, None)) is not None and pending[0] >= 0:
                yield pending[1], pending[2]

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow)

        while pending is not None:
            values, source = pending[3:], mine()
            for r in emit(values, applied(values[-1], source)):
                out.append(r)
                held += sum(len(v) for v in r if isinstance(v, str))
                if len(out) >= 5000 or held > 4_000_000:
                    yield given()
                    out, held = [], 0
            for _ in source:
                raise AssertionError("rows beyond the audit")
        if out:
            yield given()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("position"), *kept, "audit")
    both = heads.unionByName(ordered.select("conv_id", "position", "role", "text"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return both.select("position", "role", "text", "conv_id", *kept, "audit").mapInArrow(read, schema)


def repair_conversations(convs: DataFrame, every: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``convs`` (conv_id, turn, role, text[, there]).

    Returns conv_id, gaps (turns missing between the first and the last), blank, duplicate,
    truncated (rows by their first fault), illegal (adjacent initials other than su, ua, au), cost,
    audit (initials of the edits Keep, Rerole, Delete, Insert) and repaired_sha256 (of ``role:text``
    lines). Rows are taken by turn, null first, then by role and text hash; null roles and texts are
    one space. Rows with ``there`` false count as missing. A null conv_id is a conversation of its
    own. Ids of ``every`` (by default of ``convs``) without rows get zeros, an empty audit and the hash of nothing;
    an empty table gives no rows; other columns are not read.
    """
    ordered = _ordered(convs)
    kept = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [T.StructField("conv_id", convs.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in kept]]
    schema = T.StructType([*fields, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def digest(values: tuple, repaired: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        sha, between = hashlib.sha256(), b""
        for role, text in repaired:
            sha.update(between + f"{role}:{text}".encode())
            between = b"\n"
        yield (*values, sha.hexdigest())

    audits = _audits(ordered, convs if every is None else every, chunk)
    return _streamed(ordered, audits, digest, schema, kept)


def repaired_rows(convs: DataFrame, chunk: int = 4096) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text.

    Conversations that lose all their rows have none; the rest as in ``repair_conversations``.
    """
    ordered = _ordered(convs)
    schema = T.StructType(
        [
            T.StructField("conv_id", convs.schema["conv_id"].dataType),
            T.StructField("place", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def lines(values: tuple, repaired: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        for place, (role, text) in enumerate(repaired):
            yield values[0], place, role, text

    return _streamed(ordered, _audits(ordered, convs, chunk), lines, schema, [])

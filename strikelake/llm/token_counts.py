"""Token counts of sections by the tokenizer's offsets: each document is encoded once, as a whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .encode import Encoder

RULES = ("start", "end", "most", "share")
SECTIONS = "section array<long>, first array<long>, last array<long>, tokens array<double>, crossing array<long>"


def sections_of(text: str, separator: re.Pattern) -> np.ndarray:
    """Begin and end of the sections of ``text``: consecutive, each with the separator that ends it."""
    ends = [m.end() for m in separator.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.stack([[0, *ends[:-1]], ends], axis=1).astype(np.int64)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens reach over one of its borders.

    ``spans`` and ``sections`` are (begin, end) in characters, sections consecutive from 0. The rule
    says where a token over a border goes: ``start`` to the section of its first character, ``end``
    to that of its last, ``most`` to the one that holds most of its characters (the first, if
    equal), ``share`` to all in proportion to its characters in each.
    """
    n = len(sections)
    begin, end = spans[:, 0], spans[:, 1]
    ends = sections[:, 1]
    first = np.minimum(np.searchsorted(ends, begin, side="right"), n - 1)
    last = np.maximum(first, np.minimum(np.searchsorted(ends, end, side="left"), n - 1))
    over = np.flatnonzero(last > first)
    crossing = np.zeros(n, np.int64)
    counts = np.zeros(n)
    if rule == "start" or not len(over):
        counts += np.bincount(first, minlength=n)
    elif rule == "end":
        counts += np.bincount(last, minlength=n)
    else:
        inside = np.ones(len(first), bool)
        inside[over] = False
        counts += np.bincount(first[inside], minlength=n)
        two = over[last[over] == first[over] + 1]
        ahead, past = ends[first[two]] - begin[two], end[two] - ends[first[two]]
        kept = ahead / (ahead + past) if rule == "share" else (ahead >= past).astype(float)
        counts += np.bincount(first[two], kept, minlength=n) + np.bincount(last[two], 1 - kept, minlength=n)
        for t in over[last[over] > first[over] + 1].tolist():
            held = np.arange(first[t], last[t] + 1)
            chars = np.minimum(ends[held], end[t]) - np.maximum(sections[held, 0], begin[t])
            if rule == "share":
                counts[held] += chars / chars.sum()
            else:
                counts[held[np.argmax(chars)]] += 1
    if len(over):
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, first[over], 1)
        np.add.at(steps, last[over] + 1, -1)
        crossing = np.cumsum(steps)[:n]
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer: str, separator: str = r"\n", rule: str = "start") -> DataFrame:
    """Tokens of every section of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, section (from 0), first and last (its characters from first to before last),
    n_tokens (double; whole numbers but for the rule ``share``) and crossing (tokens that reach over
    one of its borders). A section ends after each match of ``separator``. Under every rule the
    sections of a document add up to its tokens. A null or empty text has one empty section without
    tokens; repeated rows have sections each; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    @pandas_udf(SECTIONS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, pattern = Encoder.of(tokenizer), re.compile(separator)
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                sections = sections_of(text, pattern)
                counts, crossing = attribute(coder.spans(text), sections, rule)
                rows.append((np.arange(len(sections)), sections[:, 0], sections[:, 1], counts, crossing))
            yield pd.DataFrame(rows, columns=["section", "first", "last", "tokens", "crossing"])

    found = docs.select("doc_id", counted(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s"))
    each = F.explode(F.arrays_zip("s.section", "s.first", "s.last", "s.tokens", "s.crossing")).alias("s")
    return found.select("doc_id", each).select(
        "doc_id", "s.section", "s.first", "s.last", F.col("s.tokens").alias("n_tokens"), "s.crossing"
    )


def field_tokens(docs: DataFrame, fields: list[str], tokenizer: str, glue: str = "\n", rule: str = "start") -> DataFrame:
    """Tokens of every field of records that are encoded as one text, ``fields`` joined by ``glue``.

    Returns doc_id, field, n_tokens (double), crossing. The glue belongs to the field before it; a
    null field is empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    @pandas_udf("field array<string>, tokens array<double>, crossing array<long>")
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder.of(tokenizer)
        for frame in batches:
            rows = []
            for values in frame.itertuples(index=False):
                parts = [(v or "") + glue for v in values]
                parts[-1] = parts[-1][: len(parts[-1]) - len(glue)]
                ends = np.cumsum([len(p) for p in parts])
                sections = np.stack([np.concatenate(([0], ends[:-1])), ends], axis=1)
                rows.append((fields, *attribute(coder.spans("".join(parts)), sections, rule)))
            yield pd.DataFrame(rows, columns=["field", "tokens", "crossing"])

    parts = F.struct(*[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    found = docs.select("doc_id", counted(parts).alias("s"))
    each = F.explode(F.arrays_zip("s.field", "s.tokens", "s.crossing")).alias("s")
    return found.select("doc_id", each).select("doc_id", "s.field", F.col("s.tokens").alias("n_tokens"), "s.crossing")

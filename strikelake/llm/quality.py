"""Quality by ridge regression on random Fourier features of document statistics, calibrated.

The features cos(w x + b) with Gaussian w approximate a Gaussian kernel, so a linear fit on them
approximates kernel ridge regression. The normal equations are sums over rows: every partition
hands on its sum, whose size depends on the number of features only.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .calibration import calibrated, isotonic, split
from .shared import labelled_sample

STATISTICS = (
    "log_words log_bytes word_length capitals digits symbols punctuation exclaims bars unique_words repeated_words top_word "
    "log_lines words_per_line repeated_lines beyond_ascii short_words long_words shouted word_marks"
).split()
_PUNCTUATION, _SYMBOLS = b".,;:!?'\"()-", b"@#$%^&*~<>_=+\\/[]{}"
_ASCII = bytes(range(128))


def statistics_of(text: bytes | None) -> list[float]:
    """``STATISTICS`` of one UTF-8 text; zeros for null, empty and blank text."""
    raw = text or b""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)

    def share(of: bytes) -> float:
        return (size - len(raw.translate(None, of))) / size

    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), np.log1p(size), min(lengths.mean(), 30.0) / 10, share(string.ascii_uppercase.encode()), share(string.digits.encode()),
        share(_SYMBOLS), share(_PUNCTUATION), min(raw.count(b"!") / n, 3.0), min(raw.count(b"|") / n, 3.0), len(counts) / n,
        sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, np.log1p(len(lines)), np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines), len(raw.translate(None, _ASCII)) / size, float((lengths <= 2).mean()), float((lengths >= 15).mean()),
        sum(map(bytes.isupper, words)) / n, 1 - sum(map(bytes.isalnum, words)) / n,
    ]


def statistics_column(text: Column) -> Column:
    """Array of ``STATISTICS`` of a text column."""

    @pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics_of(t) for t in texts], dtype=object)

    return measured(text.cast("string").cast("binary"))


class FourierRidge:
    """Standardised statistics -> random Fourier features -> ridge score -> calibrated score."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.waves = random.normal(0.0, 1.0 / width, (len(mean), features))
        self.phases = random.uniform(0.0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The Fourier features of rows of statistics, and a constant."""
        x = np.clip((x - self.mean) / self.deviation, -10, 10)
        z = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.waves + self.phases)
        return np.column_stack([z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(x), self.curve)


def normal_equations(rows: DataFrame, model: FourierRidge) -> np.ndarray:
    """Sums over ``rows`` (x, label) of z zᵀ, with z label as the last column."""
    n = len(model.weights)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n + 1))
        for frame in frames:
            z = model.lifted(np.stack(frame["x"].to_numpy()))
            total += z.T @ np.column_stack([z, frame["label"].to_numpy(np.float64)])
        yield pd.DataFrame({"line": range(n), "sums": list(total)})

    parts = rows.select("x", "label").mapInPandas(summed, "line int, sums array<double>")
    added = parts.groupBy("line").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))
    # One line for each feature, whatever the number of rows.
    lines = {r["line"]: r["sums"].toArray() for r in added.collect()}
    return np.array([lines.get(i, np.zeros(n + 1)) for i in range(n)])


def train_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 40_000,
    features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 5,
) -> FourierRidge:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` (doc_id, text) outside the held-out fold.

    ``labels`` has doc_id and quality (0 or 1). Four fifths of the sample fit the ridge, the rest the
    isotonic curve. Without labelled rows every score is 0.
    """
    known = labelled_sample(docs, labels, "quality", folds, held_out, max_rows)
    sample = cut_lineage(known.select("doc_id", statistics_column(F.col("text")).alias("x"), "label"))
    fitting, calibrating = split(sample)
    k = len(STATISTICS)
    moments = fitting.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(k)],
    ).first()
    if not moments["n"]:
        return FourierRidge(np.zeros(k), np.ones(k), features, width, seed)
    mean, deviation = (np.array([moments[f"{c}{i}"] for i in range(k)], float) for c in "md")
    model = FourierRidge(mean, deviation, features, width, seed)
    sums = normal_equations(fitting, model)
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * moments["n"] * np.eye(len(sums)), sums[:, -1])

    @pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    model.curve = isotonic(calibrating.select(raw("x").alias("raw"), "label"))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id and calibrated quality of every whole text of ``docs`` (doc_id, text).

    Null, empty and blank texts have all statistics 0 and get the score of that point; repeated rows
    have a score each. Only the text is scored.
    """
    model = train_quality(docs, labels, folds, held_out, **options)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics_of(t) for t in texts], float).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x), dtype="float64")

    return docs.select("doc_id", scored(F.col("text").cast("string").cast("binary")).alias("score"))

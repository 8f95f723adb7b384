"""Exact top-k inner-product search, pruned by segment means and deviations from coarse to fine.

A vector cut into segments of m components has, for each segment, a mean and a deviation. Two
vectors' squared distance is at least the sum over segments of m ((mean difference) squared plus
(deviation difference) squared); with the vectors' norms this bounds their inner product from above
by the sum of m (mean * mean + deviation * deviation). Finer segments give tighter bounds. A
candidate whose bound is below the k-th best score known is left out; exact scores are computed for
the survivors only. Scores are integers, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FOUND = "query_id long, vec_id long, score long"
#: Queries that are compared with a block of rows at once, by products of matrices.
BATCH = 128
#: Beyond this, sums of products are no longer exact in double precision.
EXACT = float(2**53)


def segment_counts(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: powers of two up to half the components."""
    return [s for s in (2**p for p in range(1, 31)) if 2 * s <= dim] or [1]


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(m) * mean and sqrt(m) * deviation for each segment, so that a bound is a dot product."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    m = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / m
    # Summed from the differences, so that equal components have deviation 0 exactly.
    spread = np.add.reduceat((x - np.repeat(mean, m, axis=1)) ** 2, cuts, axis=1)
    return np.concatenate([mean * np.sqrt(m), np.sqrt(spread)], axis=1)


class Block:
    """Integer vectors of one length with their statistics at every resolution."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.stats = [segment_stats(vectors, s) for s in segment_counts(vectors.shape[1])] if vectors.shape[1] else []


def best_of_block(queries: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the rows that can be among the ``k`` best of each query in this
    block: at most k + ties cut by smaller id."""
    large = max(np.abs(queries.vectors).max(initial=0), 1) * max(np.abs(rows.vectors).max(initial=0), 1)
    slack = 1e-9 * large * max(1, queries.vectors.shape[1]) + 1e-6
    exact = large * max(1, queries.vectors.shape[1]) < EXACT
    found = [], [], []
    for first in range(0, len(queries.ids), BATCH):
        some = slice(first, first + BATCH)
        alive = queries.ids[some, None] != rows.ids
        if exact:
            left, scores = _pruned_scores(queries, rows, some, alive, k, slack)
        else:
            left, scores = np.arange(len(rows.ids)), _limited_scores(queries.vectors[some], rows.vectors)
        alive = alive[:, left]
        if len(left) > k:
            ranked = np.where(alive, scores, -np.inf if exact else -(2**64))
            alive &= ranked >= np.partition(ranked, len(left) - k, axis=1)[:, [len(left) - k]]
        q, r = np.nonzero(alive)
        order = np.lexsort((rows.ids[left[r]], -scores[q, r], q))
        q, r = q[order], r[order]
        # Their places in their query's list, which starts where the query is first seen.
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        for out, values in zip(found, (queries.ids[some][q], rows.ids[left[r]], scores[q, r])):
            out.append(values[best].astype(np.int64))
    return tuple(np.concatenate([np.array([], np.int64), *out]) for out in found)


def _pruned_scores(queries: Block, rows: Block, some: slice, alive: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that the bounds leave to any query of ``some``, and their exact scores.

    ``alive`` marks the candidates (queries by rows); those whose bound is below a query's floor are unmarked.
    """
    asked, left, floor = queries.vectors[some], np.arange(len(rows.ids)), np.full((len(alive), 1), -np.inf)

    def of(table: np.ndarray) -> np.ndarray:
        return table if len(left) == len(table) else table[left]

    for level, stats in enumerate(queries.stats):
        bound = stats[some] @ of(rows.stats[level]).T
        if level == 0 and len(rows.ids) > k:
            # Exact scores of the likeliest rows give the first floor.
            bound[~alive] = -np.inf
            likely = np.argpartition(bound, len(rows.ids) - k, axis=1)[:, -k:]
            floor = np.einsum("qkd,qd->qk", rows.vectors[likely], asked).min(axis=1, keepdims=True)
            floor[alive.sum(axis=1) <= k] = -np.inf
        low = bound < floor - slack
        if low.any():
            alive[:, left] &= ~low
            left = left[alive[:, left].any(axis=0)]
    return left, asked @ of(rows.vectors).T


def _limited_scores(asked: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores beyond double precision as Python's whole numbers, at the limits of a long."""
    asked, vectors = ([[int(v) for v in x] for x in m] for m in (asked, vectors))
    scores = np.empty((len(asked), len(vectors)), object)
    for i, x in enumerate(asked):
        for j, y in enumerate(vectors):
            scores[i, j] = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y))))
    return scores


def _matrix(values: pd.Series, scale: int) -> np.ndarray:
    """Components as whole numbers, held as doubles; beyond the range of doubles they stand at its limit."""
    return np.nan_to_num(np.floor(scale * np.stack([np.asarray(v, np.float64) for v in values])))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, query_block: int = 2048, row_block: int = 8192
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, embedding) for each row that ``is_query`` marks.

    Components x become floor(scale * x), in double precision; the score is their integer inner
    product; ties go to the smaller vec_id; a query is not its own candidate. Returns query_id, rank
    (from 1), vec_id, score. Left out are rows without id, vectors that are null, empty or hold null
    or non-finite components; vectors of different lengths do not meet. Rows of one id count as
    one: the first by their components. A score that no long can hold stands at its limit.

    Queries and rows are dealt into blocks of about ``query_block`` and ``row_block`` rows by a hash
    of their id; each pair of blocks is one group, whose size does not depend on the table's. Every
    group hands on k rows a query, which are merged by query.
    """
    clean = F.size("embedding") > 0
    for bad in (lambda x: x.isNull(), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))):
        clean = clean & ~F.coalesce(F.exists(F.col("embedding").cast("array<double>"), bad), F.lit(False))
    # Floats stay floats until a task reads them: half the size in the shuffles.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & clean).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("asks").alias("asks")))
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    n_rows, n_queries = (max(1, -(-n // block)) for n, block in zip(sizes, (row_block, query_block)))
    at = F.xxhash64("vec_id")

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            F.size("x").alias("dim"),
            F.pmod(at, F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
            "vec_id",
            "x",
        )

    left = dealt(rows.where("asks"), "qb", n_queries, "rb", n_rows)
    right = dealt(rows, "rb", n_rows, "qb", n_queries).select("dim", "qb", "rb", "vec_id", "x")
    key = ["dim", "qb", "rb"]

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        block = [Block(f["vec_id"].to_numpy(np.int64), _matrix(f["x"], scale)) for f in (queries, candidates)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best_of_block(*block, k))))

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(38,0)")).alias("less"), "vec_id", "score")))
    best = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"
    )

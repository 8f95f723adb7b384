"""Isotonic calibration of classifier scores on a part of the labelled sample that did not fit them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One labelled row in this many calibrates instead of fitting.
CALIBRATE_EVERY = 5


def split(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a labelled sample that fit a model, and those that calibrate it, by a hash of the id."""
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATE_EVERY))
    return sample.where(part != 0), sample.where(part == 0)


def isotonic(scored: DataFrame, prior_steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the share of label 1 at them, never falling, from ``scored`` (raw, label).

    Apply with ``calibrated``. Beside the rows stand ``prior_steps`` + 1 pseudo-rows, evenly from 0 to 1,
    whose label is their score: a prior that scores mean what they say. It outweighs a handful of
    rows, and thousands outweigh it. Without rows every score stays as it is, cut to 0 and 1.
    """
    said = scored.sparkSession.range(prior_steps + 1).select((F.col("id") / prior_steps).alias("raw"), (F.col("id") / prior_steps).alias("label"))
    rows = scored.select("raw", F.col("label").cast("double").alias("label")).unionByName(said)
    model = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="share").fit(rows)
    return model.boundaries.toArray(), model.predictions.toArray()


def calibrated(raw: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Calibrated scores of 0 to 1: linear between the curve's points, level outside."""
    return np.clip(np.interp(raw, *curve), 0.0, 1.0)


def calibrated_column(raw: Column, curve: tuple[np.ndarray, np.ndarray]) -> Column:
    """``calibrated`` of a column of scores, as an expression: no second Python worker beside the one
    that measured the texts. The curve's points are constants; there are at most as many as rows of
    the labelled sample that calibrate."""
    at, shares = (F.lit([float(v) for v in values]) for values in curve)
    passed = F.size(F.filter(at, lambda point: point <= raw))
    low, high = F.greatest(passed, F.lit(1)), F.least(passed + 1, F.lit(len(curve[0])))
    begin, end = F.element_at(at, low), F.element_at(at, high)
    way = F.when(end > begin, (raw - begin) / (end - begin)).otherwise(0.0)
    share = F.element_at(shares, low) + way * (F.element_at(shares, high) - F.element_at(shares, low))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))

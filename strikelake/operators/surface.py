"""Implied volatility at any strike offset: a natural cubic spline per bar time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import valid_iv


def iv_surface(bars: DataFrame) -> DataFrame:
    """Sorted (offset, iv) points per bar time with at least three distinct offsets.

    Where both option types quote an offset, the first by type counts. A chain has a few
    dozen strikes at most, so the arrays are short.
    """
    pts = bars.where(valid_iv("iv")).groupBy("symbol", "date", "time", "strike_offset").agg(
        F.min_by("iv", "option_type").alias("iv")
    )
    arrays = pts.groupBy("symbol", "date", "time").agg(
        F.array_sort(F.collect_list(F.struct(F.col("strike_offset").cast("double").alias("offset"), "iv"))).alias("points")
    )
    return arrays.where(F.size("points") >= 3)


def with_bends(surface: DataFrame) -> DataFrame:
    """Add ``bends``, the spline's second derivative at each point: zero at both ends.

    The slopes meet at the inner points, which is one equation for each and its two neighbours. A
    forward pass takes the left neighbour out of each equation (``c`` and ``d`` then say what the
    right one leaves of it), a backward pass fills in the values. Both are folds over the points.
    """
    n = F.size("points")

    def at(i: Column) -> Column:
        return F.get("points", i)

    def forward(done: Column, i: Column) -> Column:
        before, here, after = at(i - 1), at(i), at(i + 1)
        left, right = here["offset"] - before["offset"], after["offset"] - here["offset"]
        turn = 6 * ((after["iv"] - here["iv"]) / right - (here["iv"] - before["iv"]) / left)
        last = F.get(done, i - 1)
        pivot = 2 * (left + right) - left * last["c"]
        return F.concat(done, F.array(F.struct((right / pivot).alias("c"), ((turn - left * last["d"]) / pivot).alias("d"))))

    start = F.array(F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d")))
    passed = surface.withColumn("_f", F.aggregate(F.sequence(F.lit(1), n - 2), start, forward))

    def backward(done: Column, i: Column) -> Column:
        row = F.get("_f", i)
        return F.concat(F.array(row["d"] - row["c"] * F.get(done, F.lit(0))), done)

    inner = F.aggregate(F.sequence(n - 2, F.lit(1), F.lit(-1)), F.array(F.lit(0.0)), backward)
    return passed.withColumn("bends", F.concat(F.array(F.lit(0.0)), inner)).drop("_f")


def iv_at(surface: DataFrame, requests: DataFrame) -> DataFrame:
    """IV for requested (symbol, date, time, offset); times without a surface are absent.

    The curve is solved once a surface, before requests meet it; outside its points it is flat.
    """
    solved = surface if "bends" in surface.columns else with_bends(surface)
    x, points = F.col("offset").cast("double"), F.col("points")
    j = requests.join(solved, ["symbol", "date", "time"])
    j = j.withColumn("_i", F.size(F.filter(points, lambda p: p["offset"] <= x)) - 1)
    lo, hi = F.get(points, F.col("_i")), F.get(points, F.col("_i") + 1)
    m0, m1 = F.get("bends", F.col("_i")), F.get("bends", F.col("_i") + 1)
    h, down, up = hi["offset"] - lo["offset"], hi["offset"] - x, x - lo["offset"]
    curve = (m0 * down * down * down + m1 * up * up * up) / (6 * h) + (lo["iv"] / h - m0 * h / 6) * down + (hi["iv"] / h - m1 * h / 6) * up
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    value = F.when(x <= first["offset"], first["iv"]).when(x >= last["offset"], last["iv"]).when(lo["offset"] == x, lo["iv"]).otherwise(curve)
    return j.withColumn("iv", value).drop("points", "bends", "_i")

"""Parameter grids and sweeps: every combination is just another run of one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import metrics as M
from . import replay as R

MEASURES = ["sharpe_ratio", "total_pnl_net", "max_drawdown_pct", "total_trades", "win_rate_pct", "profit_factor", "cagr"]


def _steps(low: float, high: float, step: float) -> int:
    return 1 if step <= 0 or low > high else int(math.floor((high - low + 1e-9) / step)) + 1


def _size(ranges: list[dict]) -> int:
    return math.prod(_steps(float(r["min"]), float(r["max"]), float(r["step"])) for r in ranges)


def _params(ranges: list[dict], combo: Column) -> Column:
    """Parameter map of a combination number, decoded from its mixed-radix digits."""
    if not ranges:
        return F.create_map().cast("map<string,double>")
    below, values = _size(ranges), []
    for r in ranges:
        n = _steps(float(r["min"]), float(r["max"]), float(r["step"]))
        below //= n
        digit = F.floor(combo / below) % n
        values.append(F.round(F.lit(float(r["min"])) + digit * F.lit(float(r["step"])), 3))
    return F.map_from_arrays(F.array(*[F.lit(r["name"]) for r in ranges]), F.array(*values))


def range_values(low: float, high: float, step: float) -> Column:
    """Array low, low+step, ... up to high; only low when the range is empty or has no step."""
    i = F.sequence(F.lit(0), F.lit(_steps(low, high, step) - 1))
    return F.transform(i, lambda x: F.round(F.lit(float(low)) + x * F.lit(float(step)), 3))


def param_grid(spark: SparkSession, ranges: list[dict]) -> DataFrame:
    """(combo_index, params) for all combinations; the last parameter varies fastest.

    The grid is generated by number, so it needs no join. No ranges give one combination
    without overrides.
    """
    grid = spark.range(_size(ranges)).withColumnRenamed("id", "combo_index")
    return grid.withColumn("params", _params(ranges, F.col("combo_index")))


def apply_overrides(runs: DataFrame, legs: DataFrame, ranges: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Every run under every combination of the grid; run ids become ``run#combo``.

    sl_value sets all legs' stop, target_value the overall target (and enables it),
    strike_offset and lots (at least 1) all legs; other names are ignored. The tables are as large
    as symbols times combinations, which an exploded plan does not show: they ask for merge joins, so
    that none is gathered on the driver to be broadcast.
    """
    c = F.col
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_size(ranges) - 1).cast("bigint")))
    base = runs.select("*", numbers.alias("combo_index")).withColumn("params", _params(ranges, c("combo_index")))
    base = base.withColumnRenamed("run_id", "base_run_id").withColumn("run_id", F.concat_ws("#", "base_run_id", "combo_index")).hint("merge")

    def value(name: str):
        return F.try_element_at("params", F.lit(name))

    new_runs = base.withColumn(
        "overall_target_enabled", c("overall_target_enabled") | value("target_value").isNotNull()
    ).withColumn("overall_target_value", F.coalesce(value("target_value"), "overall_target_value"))
    keyed = base.select("base_run_id", c("run_id").alias("_id"), "params")
    new_legs = (
        legs.withColumnRenamed("run_id", "base_run_id").join(keyed, "base_run_id")
        .withColumn("stop_loss_value", F.coalesce(value("sl_value"), "stop_loss_value"))
        .withColumn("strike_offset", F.coalesce(value("strike_offset").cast("int"), "strike_offset"))
        .withColumn("lots", F.coalesce(F.greatest(value("lots").cast("int"), F.lit(1)), "lots"))
        .withColumn("run_id", c("_id"))
    )
    return new_runs, new_legs.select(*legs.columns).hint("merge")


def sweep_metrics(bars: DataFrame, runs: DataFrame, legs: DataFrame, ranges: list[dict]) -> DataFrame:
    """Metrics per base run and combination from one replay over all of them."""
    many, many_legs = apply_overrides(runs, legs, ranges)
    done = R.replay(bars, many.drop("base_run_id", "combo_index", "params"), many_legs, thin=True)
    span = done.spine.groupBy("symbol").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    table = many.select("run_id", "symbol", "capital").join(span, "symbol").hint("merge")
    # As in a thin replay: their files say too little of the size of these tables.
    trades, marks = cut_lineage(done.trades).hint("merge"), done.marks.hint("merge")
    daily = R.daily_equity_of(done.spine, done.runs, marks, trades)
    m = M.run_metrics(trades, daily, table, R.TRADE_ORDER)
    return many.select("run_id", "base_run_id", "combo_index", "params").join(m, "run_id")


def top_combos(results: DataFrame, k: int = 100) -> DataFrame:
    """Best k by Sharpe; combination number breaks ties."""
    return results.orderBy(F.desc_nulls_last("sharpe_ratio"), "combo_index", "base_run_id").limit(k)


def param_sweep(bars: DataFrame, runs: DataFrame, legs: DataFrame, ranges: list[dict], k: int = 100) -> DataFrame:
    top = top_combos(sweep_metrics(bars, runs, legs, ranges), k)
    return top.select("base_run_id", "combo_index", "params", *MEASURES)

"""Result tables (trades, equity curves, metrics, sweep results) as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import safe_int, safe_num
from ..operators.ordered import number_rows

TRADE_TEXT = "entry_date exit_date entry_time exit_time option_type position_side exit_reason".split()
TRADE_NUMBERS = """entry_price exit_price entry_spot exit_spot pnl_gross pnl_net brokerage stt
    slippage_cost other_charges""".split()
TRADE_INTS = "lots lot_size bars_held reentry_attempt".split()


def trade_rows(trades: DataFrame, order: list) -> DataFrame:
    """Storable trades: numbered within their run, unusable numbers as NULL."""
    if all(isinstance(o, str) for o in order):
        # Only what is stored or ordered by goes through the sort.
        needed = {"run_id", *order, *TRADE_TEXT, *TRADE_NUMBERS, *TRADE_INTS}
        trades = trades.select(*[n for n in trades.columns if n in needed])
    numbered = number_rows(trades, ["run_id"], order, "_n")
    return numbered.select(
        F.col("run_id"),
        (F.col("_n") - 1).alias("trade_id"),
        *[F.col(c) for c in TRADE_TEXT if c in trades.columns],
        *[safe_num(c).alias(c) for c in TRADE_NUMBERS if c in trades.columns],
        *[safe_int(c).alias(c) for c in TRADE_INTS if c in trades.columns],
    )


def equity_rows(daily: DataFrame) -> DataFrame:
    """Stored curve: equity and percent below the running peak of the curve itself."""
    w = Window.partitionBy("run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    dd = F.when(peak > 0, (peak - F.col("equity")) / F.when(peak > 0, peak) * 100).otherwise(0.0)
    return daily.select("run_id", "date", safe_num("equity").alias("equity"), safe_num(dd).alias("drawdown_pct"))


def metrics_long(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """Wide metrics to (key, metric_name, metric_value); infinities become NULL."""
    names = [c for c in metrics.columns if c != key]
    wide = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    long = wide.unpivot([key], names, "metric_name", "metric_value")
    return long.withColumn("metric_value", safe_num("metric_value"))


def metrics_map(long: DataFrame, key: str = "run_id") -> DataFrame:
    """Metrics of a run as one name-to-value map."""
    entries = F.collect_list(F.struct("metric_name", "metric_value"))
    return long.groupBy(key).agg(F.map_from_entries(entries).alias("metrics"))


def sweep_rows(results: DataFrame, optimizer_run_id: str) -> DataFrame:
    """Sweep results with parameters and metrics as JSON text."""
    measures = [c for c in results.columns if c not in ("combo_index", "params")]
    return results.select(
        F.lit(optimizer_run_id).alias("optimizer_run_id"),
        "combo_index",
        F.to_json("params").alias("params"),
        F.to_json(F.struct(*[safe_num(c).alias(c) for c in measures])).alias("metrics"),
    )


def read_sweep_rows(rows: DataFrame) -> DataFrame:
    """JSON columns back to maps."""
    kind = "map<string,double>"
    return rows.withColumns({"params": F.from_json("params", kind), "metrics": F.from_json("metrics", kind)})


def write_table(df: DataFrame, base: str, table: str, by: str = "run_id", mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(by).parquet(f"{base}/{table}")


def write_results(trades: DataFrame, equity: DataFrame, metrics: DataFrame, base: str, order: list) -> None:
    """Append the three tables of one or many runs, partitioned by run."""
    write_table(trade_rows(trades, order), base, "trades")
    write_table(equity_rows(equity), base, "equity_curves")
    write_table(metrics_long(metrics), base, "metrics")


def read_results(spark: SparkSession, base: str, table: str, run_id=None) -> DataFrame:
    """One result table; a run id prunes to its partition."""
    df = spark.read.parquet(f"{base}/{table}")
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def recent_runs(runs: DataFrame, strategies: DataFrame | None = None, n: int | None = None, status: str | None = None) -> DataFrame:
    """Runs, newest first, with their strategy's name; optionally one status or the first n."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if strategies is not None:
        names = strategies.select("strategy_id", F.col("name").alias("strategy_name"), "underlying")
        runs = runs.join(names, "strategy_id", "left")
    ordered = runs.orderBy(F.desc("inserted_at"), F.desc("run_id"))
    return ordered if n is None else ordered.limit(n)


def runs_of_strategy(runs: DataFrame, strategy_id) -> DataFrame:
    return runs.where(F.col("strategy_id") == strategy_id).orderBy(F.desc("inserted_at"), F.desc("run_id"))


def strategies_by_underlying(strategies: DataFrame, underlying: str) -> DataFrame:
    return strategies.where(F.col("underlying") == underlying).orderBy("name")

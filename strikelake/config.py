"""Strategy dictionaries to the ``runs`` and ``legs`` tables.

Optional fields take their defaults; unknown fields are refused, because a misspelt stop
that is silently dropped changes results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S


def _clock(value: str) -> str:
    parts = value.split(":")
    return ":".join(p.zfill(2) for p in (parts + ["00"])[:3])


def _row(given: dict, schema, defaults: dict, what: str) -> list:
    unknown = set(given) - {f.name for f in schema.fields}
    if unknown:
        raise ValueError(f"{what}: unknown fields {sorted(unknown)}")
    merged = {**defaults, **given}
    missing = [f.name for f in schema.fields if f.name not in merged]
    if missing:
        raise ValueError(f"{what}: missing fields {missing}")
    out = []
    for f in schema.fields:
        value = merged[f.name]
        if value is not None and f.dataType.typeName() == "double":
            value = float(value)
        out.append(value)
    return out


def _check_words(given: dict, what: str) -> None:
    kinds = {
        "stop_loss_type": "stop_type",
        "target_profit_type": "stop_type",
        "overall_sl_type": "stop_type",
        "overall_target_type": "stop_type",
    }
    for field, value in given.items():
        allowed = S.ALLOWED.get(kinds.get(field, field))
        if allowed is not None and value not in allowed:
            raise ValueError(f"{what}: {field}={value!r} is not one of {sorted(allowed)}")


def strategy_rows(configs: list[dict]) -> tuple[list[list], list[list]]:
    """Checked rows of the ``runs`` and ``legs`` tables, one dictionary per run."""
    runs, legs = [], []
    for conf in configs:
        run = {k: v for k, v in conf.items() if k not in ("legs", "overall")}
        run.update(conf.get("overall", {}))
        if "underlying" in run:
            run["symbol"] = run.pop("underlying")
        run["entry_time"] = _clock(run["entry_time"])
        run["exit_time"] = _clock(run["exit_time"])
        what = f"run {run.get('run_id')}"
        _check_words(run, what)
        runs.append(_row(run, S.RUNS, S.RUN_DEFAULTS, what))
        for no, leg in enumerate(conf.get("legs", [])):
            leg = {**leg, "run_id": run["run_id"], "leg_no": no}
            leg["option_type"] = str(leg.get("option_type", "")).upper()
            _check_words(leg, f"{what} leg {no}")
            legs.append(_row(leg, S.LEGS, S.LEG_DEFAULTS, f"{what} leg {no}"))
    return runs, legs


def strategy_frames(spark: SparkSession, configs: list[dict]) -> tuple[DataFrame, DataFrame]:
    """``runs`` and ``legs`` tables from dictionaries: run fields, ``legs`` and optionally ``overall``."""
    runs, legs = strategy_rows(configs)
    return spark.createDataFrame(runs, S.RUNS), spark.createDataFrame(legs, S.LEGS)


def literals(row: list, schema: T.StructType) -> list[Column]:
    """One configuration row as constant columns."""
    return [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]


def per_symbol(configs: list[dict], symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every strategy for every symbol present; run ids become ``strategy@symbol``.

    The strategies travel as a constant array that each symbol's row unfolds.
    """
    runs, legs = strategy_rows(configs)
    every = F.array(*[F.struct(*literals(r, S.RUNS)) for r in runs])
    fanned = symbols.select("symbol").distinct().select(F.col("symbol").alias("_symbol"), F.explode(every).alias("_r"))
    fanned = fanned.select("_symbol", "_r.*").withColumn("symbol", F.col("_symbol")).withColumnRenamed("run_id", "_strategy")
    fanned = fanned.withColumn("run_id", F.concat_ws("@", "_strategy", "_symbol"))
    leg_table = symbols.sparkSession.createDataFrame(legs, S.LEGS).withColumnRenamed("run_id", "_strategy")
    spread = fanned.select("run_id", "_strategy").join(leg_table, "_strategy")
    names = [f.name for f in S.LEGS.fields]
    return fanned.select(*[f.name for f in S.RUNS.fields]), spread.select(*names)

import random

import pytest
from pyspark.sql import functions as F

from strikelake.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key, n in (("hot", 900), ("warm", 60), ("one", 1)):
        for i in range(n):
            day = i // 70
            data.append((key, day, i, rng.choice([None, rng.randint(-9, 9)]), rng.random() < (0.9 if i % 200 < 150 else 0.2)))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, day int, i int, v int, flag boolean").repartition(5)


def test_block_scan(rows):
    data, df = rows
    out = O.block_scan(
        df, ["k"], ["day"], ["i"], s=("sum", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), last=("last", F.col("v")), n=("count", F.lit(1))
    ).collect()
    got = {(r.k, r.i): (r.s, r.hi, r.lo, r["last"], r.n) for r in out}
    assert len(got) == len(data)
    for key in ("hot", "warm", "one"):
        total, hi, lo, last, n = 0, None, None, None, 0
        for _, _, i, v, _ in sorted(r for r in data if r[0] == key):
            n += 1
            if v is not None:
                total += v
                hi = v if hi is None else max(hi, v)
                lo = v if lo is None else min(lo, v)
                last = v
            assert got[(key, i)] == (total, hi, lo, last, n)


def longest(flags):
    best = {True: 0, False: 0}
    run, prev = 0, None
    for f in flags:
        run = run + 1 if f == prev else 1
        prev = f
        best[f] = max(best[f], run)
    return best[True], best[False]


def test_streaks_of_a_hot_key(rows):
    data, df = rows
    got = {r.k: (r.max_true, r.max_false) for r in O.streaks(df, ["k"], ["i"], F.col("flag")).collect()}
    for key in ("hot", "warm", "one"):
        assert got[key] == longest([r[4] for r in sorted(r for r in data if r[0] == key)])


def test_streaks_across_all_blocks(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), "id", F.lit(True).alias("f"))
    r = O.streaks(df, ["k"], ["id"], F.col("f")).first()
    assert (r.max_true, r.max_false) == (1000, 0)


def test_number_rows(rows):
    data, df = rows
    got = {(r.k, r.i): r.n for r in O.number_rows(df, ["k"], ["i"], "n").collect()}
    assert got == {(k, i): i + 1 for k, _, i, _, _ in data}


def test_number_rows_moves_rows_once(rows, spark):
    _, df = rows
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = O.number_rows(df, ["k"], ["i"], "n")
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_stored_trades_are_sorted_without_other_columns(spark, monkeypatch):
    from strikelake.sources import results

    seen = []
    monkeypatch.setattr(results, "number_rows", lambda df, *a: seen.append(df.columns) or O.number_rows(df, *a))
    df = spark.createDataFrame([(1, 2, 5.0, "x"), (1, 1, 6.0, "y")], "run_id int, orderkey int, pnl_net double, note string")
    got = results.trade_rows(df, ["orderkey"]).collect()
    assert sorted((r.trade_id, r.pnl_net) for r in got) == [(0, 6.0), (1, 5.0)]
    assert seen == [["run_id", "orderkey", "pnl_net"]]

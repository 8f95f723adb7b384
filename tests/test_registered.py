import duckdb

from strikelake.registry import replay_queries as Q
from strikelake.registry import report_queries as RQ

SMALL = "/root/testdata/sf0.001"


def test_a_price_of_zero_is_no_loss_in_both_texts(spark, tmp_path):
    duckdb.sql(f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value) FROM '{SMALL}/events.parquet'").write_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    query, sql = Q.exits_query(Q.CARRIED)
    df = query(spark, str(tmp_path))
    names = ", ".join(df.columns)
    want = con.execute(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want
    unguarded = con.execute(f"SELECT {names} FROM ({Q.replay_sql(Q.CARRIED, Q.EXITS_SELECT)})").fetchall()
    assert sorted(unguarded) != sorted(want)


def test_sweep_json_holds_every_combination(spark, monkeypatch):
    monkeypatch.setattr(RQ, "RANGES", RQ.WIDE)
    symbols = RQ.bars(spark, SMALL).select("symbol").distinct().count()
    assert sum(r.n for r in RQ.sweep_json(spark, SMALL).collect()) == 720 * symbols


def test_walk_forward_and_combined_equity_join_trades_once(spark, monkeypatch):
    calls = []
    plain = RQ.trades
    monkeypatch.setattr(RQ, "trades", lambda *a: calls.append(a) or plain(*a))
    for query in (RQ.walk_forward, RQ.combined_equity):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
    assert len(calls) == 2

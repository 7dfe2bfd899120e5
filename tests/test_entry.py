"""Driver contract on the smallest data set; a sample of queries vs DuckDB."""

import duckdb

import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and "region" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_sample_against_oracle(spark):
    from tools.check_oracle import TABLES, digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ["bi_region_pulls", "silver_player_pity", "status_changes", "history_compact", "rule_ledger",
                 "tick_fanout", "cdc_normalise", "gold_agg_player_spending"]:
        df = q[name](spark, SF_SMALL)
        s = [tuple(r) for r in df.collect()]
        rel = con.execute(o[name])
        d = rel.fetchall()
        assert digest(df.columns, s)[0] == digest([c[0] for c in rel.description], d)[0], name


def test_views_run_dashboard_sql(spark):
    from cdcmart.plans import bi, models

    wh = models.warehouse(spark, SF_SMALL)
    wh.register_views()
    sql = """select rarity, count(*) as pulls from fact_pulls group by rarity"""
    got = {r["rarity"]: r["pulls"] for r in spark.sql(sql).collect()}
    want = {r["rarity"]: r["pulls"] for r in bi.rarity_dist(wh).collect()}
    assert got == want


def test_command_line(spark, capsys):
    from cdcmart.__main__ import main

    assert main(["list"]) == 0
    assert "bi_overview" in capsys.readouterr().out
    assert main(["query", "bi_overview", "--data", SF_SMALL]) == 0
    assert "total_players" in capsys.readouterr().out
    assert main(["query", "nope", "--data", SF_SMALL]) == 2

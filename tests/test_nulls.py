"""Rows without a key, group or value."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cdcmart.operators import cdc, rules, stats
from cdcmart.operators.scan import segmented_scan
from cdcmart.session import path_exists


@pytest.fixture(scope="module")
def keyed(spark):
    r = random.Random(3)
    rows = [(None if i % 2 else i % 5, i, r.randrange(10)) for i in range(1000)]
    return spark.createDataFrame(rows, "k long, t long, v long").repartition(4)


def test_scan_with_null_keys(keyed):
    got = segmented_scan(keyed, ["k"], ["t"], {"run": ("sum", F.col("v"), True)})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = keyed.withColumn("run", F.sum("v").over(w))
    assert sorted(map(str, got.select("k", "t", "run").collect())) == sorted(map(str, want.select("k", "t", "run").collect()))


def test_rank_with_null_group(keyed):
    got = stats.global_rank(keyed, "t", "k")
    want = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("t")))
    assert sorted((str(r.k), r.t, r["rank"]) for r in got.collect()) == sorted((str(r.k), r.t, r["rank"]) for r in want.collect())


def test_ols_uses_complete_pairs(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 5.0), (1, 4.0, 4.0), (1, None, 90.0), (1, 7.0, None)]
    full = stats.ols_fit(spark.createDataFrame(rows[:4], "period int, x1 double, y double")).first()
    with_nulls = stats.ols_fit(spark.createDataFrame(rows, "period int, x1 double, y double")).first()
    assert full == with_nulls and with_nulls.n == 4


def test_single_pulls_are_no_batch(spark):
    rows = [("b", n, 1) for n in range(1, 11)] + [(None, 1, 2), (None, 1, 3)]
    got = rules.batch_integrity(spark.createDataFrame(rows, "batch_id string, pull_number int, player_id int")).collect()
    assert [(r.batch_id, r.ok) for r in got] == [("b", True)]


def test_single_pulls_are_never_repaired(spark):
    rows = [("b", 1, "R"), ("b", 2, "R"), (None, 1, "R")]
    got = rules.sr_guarantee(spark.createDataFrame(rows, "batch_id string, pull_number int, rarity string"), repair=True).collect()
    assert sorted((str(r.batch_id), r.pull_number, r.rarity, r.repaired) for r in got) == [
        ("None", 1, "R", False), ("b", 1, "R", False), ("b", 2, "SR", True)]


def test_suff_stats_use_complete_rows(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 3.0), (1, None, 90.0), (1, 7.0, None), (2, None, 1.0)]
    got = stats.suff_stats(spark.createDataFrame(rows, "period int, x1 double, y double"), "y", ["x1"], "period").collect()
    assert [(r.period, r.n, r.yy, r.xy1, r.xx1_1) for r in got] == [(1, 2, 13.0, 8.0, 5.0)]


def test_composite_key_with_a_null_half(spark):
    def message(**row):
        return json.dumps({"payload": {"before": None, "after": row, "op": "c", "ts_ms": 1,
                                       "source": {"schema": "public", "table": "player_pity"}}})

    msgs = [message(player_id="a", banner_type="b"), message(player_id="a", banner_type=None), message(banner_type="a")]
    got = cdc.route(spark.createDataFrame([(m,) for m in msgs], "value string"),
                    stable_keys={"player_pity": ["player_id", "banner_type"]})
    assert sorted(r.id for r in got.collect()) == ["a:b", '{"banner_type":"a"}', '{"banner_type":null,"player_id":"a"}']


def test_unknown_tables_are_dead_letters(spark):
    def message(table):
        return json.dumps({"payload": {"before": None, "after": {"id": 1}, "op": "c", "ts_ms": 1,
                                       "source": {"schema": "public", "table": table}}})

    rows = spark.createDataFrame([(message("pulls"),), (message("invented"),)], "value string")
    got = {(r.route, r.source_table, r.reason) for r in cdc.route(rows, tables=["pulls"]).collect()}
    assert got == {("bronze", "pulls", None), ("dlq", None, cdc.UNKNOWN_TABLE)}


def test_path_exists_propagates_errors(spark, tmp_path):
    assert path_exists(spark, str(tmp_path)) and not path_exists(spark, f"{tmp_path}/none")
    with pytest.raises(Exception):
        path_exists(spark, "nosuchscheme://host/path")

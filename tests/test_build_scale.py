"""What keeps the build in proportion to its input: source tables are read once and dealt over tasks."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from cdcmart.operators import cdc
from cdcmart.sources import adapter, tables


def _pulls(spark, ids):
    at = dt.datetime(2024, 1, 2)
    rows = [(i, None if i is None else str(i), "p1", "view", "ssr-001", "SSR", 160, at) for i in ids]
    return spark.createDataFrame(
        rows, "event_id long, id string, player_id string, banner_id string, character_id string, rarity string, crystals_spent int, pulled_at timestamp"
    )


def test_messages_of_a_pull_come_from_one_reading(spark):
    made = spark.sparkContext.accumulator(0)

    def passed(n):
        made.add(1)
        return n

    ids = [*range(520), 7, None]
    rows = _pulls(spark, ids)
    once = rows.withColumn("player_id", F.udf(passed, "string")("player_id"))
    texts = [r.json for r in adapter.pull_messages(once).collect()]
    assert made.value == len(ids)
    whole, cut = [], 0
    for t in texts:
        try:
            whole.append(json.loads(t)["payload"])
        except ValueError:
            cut += 1
    named = [i for i in ids if i is not None]
    doubled = [i for i in named if i % 59 == 7]
    assert cut == sum(1 + (i % 59 == 7) for i in named if i % 103 == 0)
    sources = [m for m in whole if isinstance(m.get("source"), dict) and "version" in m["source"]]
    text = lambda xs: sorted(str(i) for i in xs)
    whole_of = lambda op: sorted(m["before" if op == "d" else "after"].get("id") or "" for m in sources if m.get("op") == op)
    assert whole_of("u") == text(i for i in named if i % 5 == 0)
    assert whole_of("d") == text(i for i in named if i % 17 == 0)
    created = [i for i in [*named, *doubled] if i % 103]
    assert whole_of("c") == text(i for i in created if i % 101)
    # without an op: a null id has no remainder
    assert whole_of(None) == ["", *text(i for i in created if i % 101 == 0)]
    assert len(whole) - len(sources) == sum(i % 101 == 50 for i in named)
    for m in sources:
        if m.get("op") == "u":
            late = 20 * 86_400_000 if int(m["after"]["id"]) % 20 == 0 else 0
            assert m["before"] == m["after"] and m["after"]["crystals_spent"] == 320
            assert m["ts_ms"] == 1704153600000 + 60000 + late
        elif m.get("op") == "d":
            assert m["before"]["crystals_spent"] == 160 and m["after"] is None


def test_one_row_group_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_BYTES", 4000)
    monkeypatch.setattr(tables, "LEAST_BYTES", 1000)
    _pulls(spark, [*range(3000), 5, None]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = tables.load_spread(spark, str(tmp_path), "events")
    stored = tables.stored_bytes(spark, f"{tmp_path}/events.parquet")
    n = rows.rdd.getNumPartitions()
    assert tables.load(spark, str(tmp_path), "events").rdd.getNumPartitions() == 1
    assert n >= stored / 4000 > 1 and n >= min(spark.sparkContext.defaultParallelism, stored // 1000)
    dealt = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 3002 and max(dealt) < 3 * 3002 / n
    # a small table is not dealt
    monkeypatch.setattr(tables, "LEAST_BYTES", 1 << 30)
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1 << 30)
    assert tables.load_spread(spark, str(tmp_path), "events").rdd.getNumPartitions() == 1


def test_row_text_is_that_of_variant(spark):
    rows = [
        '{"id":1,"b":null,"a":{"z":[1,2.50,{"y":"q\\"\\u00e9\\n"}],"k":{}},"":true}', '{"b":1e3,"a":"\\u2028/</\\\\","c":-0.0,"d":12345678901234567890}',
        "{}", "[]", '["x",null]', '"t"', "0", "1.0", "null", "true", '{"id":null}', '{"k\\"\\n":"v"}',
    ]
    texts = [f'{{"payload":{{"after":{r}}}}}' for r in rows] + ['{"payload":{}}', "[1]"]
    m = spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_parse_json("t").alias("msg"))
    both = m.select(cdc._json_text(F.col("msg"), "$.payload.after").alias("got"), F.to_json(F.try_variant_get("msg", "$.payload.after", "variant")).alias("want"))
    got = both.collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got is not None for r in got) == len(rows)


def test_reconciliation_reads_the_source_that_the_build_wrote(spark, monkeypatch):
    from cdcmart.plans import models, registry

    data = "/root/testdata/sf0.001"
    w = models.warehouse(spark, data)

    def again(*_):
        raise AssertionError("the source tables are made again")

    for name in ("source_tables", "base_tables", "replayed_tables"):
        monkeypatch.setattr(adapter, name, again)
    sides = {name: rows for name, rows, _, _ in registry._sides(spark, data)}
    assert sorted(sides) == sorted(m.removeprefix("stg_") for m in models.SILVER_MODELS)
    assert sides["players"].count() == w.source("players").count() > 0

"""Silver as keyed state of a stream: order, restart, tombstones and their timers."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cdcmart.operators import silver
from cdcmart.streaming import silver_state as ss

T0 = dt.datetime(2024, 1, 1)
BRONZE = ("id string, data string, event string, event_timestamp timestamp, source_table string, source_schema string, "
          "ingested_at timestamp")


def rows(spark, *items):
    out = []
    for table, data, event, minute in items:
        at = T0 + dt.timedelta(minutes=minute)
        out.append((data.get("id", "x"), json.dumps(data), event, at, table, "public", at))
    return spark.createDataFrame(out, BRONZE)


def pull(rid, event, minute, rarity):
    return ("pulls", {"id": rid, "rarity": rarity}, event, minute)


def feed(spark, base, n, *items):
    rows(spark, *items).coalesce(1).write.parquet(f"{base}/in/part{n}")
    return spark.readStream.schema(BRONZE).option("maxFilesPerTrigger", "1").parquet(f"{base}/in/*")


#: Ways to run: deletes left out, ranked, and ranked with tombstones that end.
WAYS = [{}, {"honor_deletes": True}, {"retention_ms": 90 * 86_400_000, "delay": "30 days"}]


@pytest.mark.parametrize("args", WAYS)
def test_out_of_order_batches_and_restart(spark, tmp_path, args):
    """Later micro-batches may carry older changes; every batch is a new run of the
    stream with the same checkpoint."""
    want = {"2": "R", "3": "R"} if args else {"1": "SR", "2": "R", "3": "R"}
    for n, items in enumerate((
        [pull("1", "update", 2, "SR"), pull("1", "delete", 3, "SR"), pull("2", "insert", 5, "R")],
        [pull("1", "insert", 1, "R"), pull("2", "update", 4, "SSR"), pull("3", "insert", 6, "R")],
        [pull("1", "insert", 1, "R"), ("invented", {"id": "1"}, "insert", 9)],
    )):
        stream = feed(spark, tmp_path, n, *items)
        q = ss.merge_sink(stream, f"{tmp_path}/ck", every=None, changes=f"{tmp_path}/changes", **args)
        q.awaitTermination()
    got = {r["id"]: r["rarity"] for r in ss.silver_table(spark, f"{tmp_path}/ck", "pulls").collect()}
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/changes").count() >= 3
    assert {r[0] for r in ss.state(spark, f"{tmp_path}/ck").select("source_table").distinct().collect()} == {"pulls"}


@pytest.mark.parametrize("args", WAYS)
def test_state_equals_the_batch_build(spark, tmp_path, args):
    r = random.Random(5)
    items = []
    for n in range(300):
        event = r.choice(["insert", "update", "update", "delete"])
        table = r.choice(["pulls", "players", "player_pity", "banners"])
        data = {"id": str(r.randrange(25)), "rarity": r.choice(["R", "SR"]), "region": r.choice(["A", None]), "start_date": r.randrange(9)}
        if table == "player_pity":
            data = {"player_id": str(r.randrange(9)), "banner_type": r.choice(["limited", "permanent", None]), "pity_count": n}
        items.append((table, data, event, r.randrange(200)))
    for n in range(3):
        stream = feed(spark, tmp_path, n, *items[n::3])
    q = ss.merge_sink(stream, f"{tmp_path}/ck", every=None, **args)
    q.awaitTermination()
    bronze = rows(spark, *items)
    for table in ("pulls", "players", "player_pity", "banners"):
        full = silver.build_silver(bronze, table, honor_deletes=bool(args))
        held = ss.silver_table(spark, f"{tmp_path}/ck", table)
        assert held.columns == full.columns
        assert sorted(map(str, held.collect())) == sorted(map(str, full.collect())), table


def test_tombstones_leave_the_state(spark, tmp_path):
    """A tombstone goes when the watermark passes its retention; a key that came back
    keeps its row."""
    hour, args = 60, {"every": None, "delay": "1 minute", "retention_ms": 3_600_000}
    batches = [
        [pull("1", "insert", 0, "R"), pull("2", "insert", 0, "R"), pull("2", "delete", 1, "R"), pull("3", "delete", 1, "R")],
        [pull("3", "insert", 2, "SR"), pull("4", "insert", hour + 30, "R")],
        [pull("4", "update", 2 * hour, "SSR")],
    ]
    held = []
    for n, items in enumerate(batches):
        ss.merge_sink(feed(spark, tmp_path, n, *items), f"{tmp_path}/ck", **args).awaitTermination()
        held.append({json.loads(r.key)[0]: r.event for r in ss.state(spark, f"{tmp_path}/ck").collect()})
    assert held[0] == {"1": "insert", "2": "delete", "3": "delete"}
    assert held[-1] == {"1": "insert", "3": "insert", "4": "update"}


def test_state_key_keeps_null_halves(spark):
    made = rows(spark, ("player_pity", {"player_id": "1"}, "insert", 0), ("player_pity", {"player_id": "1", "banner_type": ""}, "insert", 0),
                ("pulls", {"rarity": "R"}, "insert", 0))
    assert [r[0] for r in made.select(ss.state_key()).collect()] == ['["1",null]', '["1",""]', "[null]"]
    assert made.where(F.col("source_table") == "pulls").count() == 1

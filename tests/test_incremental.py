"""Incremental Silver, Gold and history against full builds of the same log."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cdcmart.operators import cdc, delta, gold, silver
from cdcmart.plans import incremental
from cdcmart.plans.models import GOLD_MODELS, SILVER_MODELS, gold_from

T0 = 1_704_067_200_000


def message(table, row, op, ms):
    body = {"before": row if op == "d" else None, "after": None if op == "d" else row}
    return json.dumps({"payload": {**body, "source": {"schema": "public", "table": table}, "op": op, "ts_ms": T0 + ms}})


def iso(ms):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)).isoformat() + "Z"


def random_log(seed, n, deletes):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        table, op, ms = r.choice(["pulls", "pulls", "players", "transactions", "banners"]), r.choice("ccuu" + "d" * deletes), r.randrange(40) * 1000
        key = str(r.randrange(20))
        player = r.choice([None, *map(str, range(6))])
        row = {
            "pulls": {"id": key, "player_id": player, "banner_id": "b", "character_id": r.choice(["c1", "c2", "c3", None]), "rarity": r.choice(["SSR", "SR", "R", None]),
                      "pity_count": r.choice([None, 3, 70]), "crystals_spent": r.choice([None, 160, 320]), "pulled_at": iso(ms)},
            "players": {"id": str(r.randrange(6)), "username": f"u{r.randrange(3)}", "region": r.choice(["EU", "NA", None]), "crystal_balance": r.randrange(9)},
            "transactions": {"id": key, "player_id": player, "amount_usd": r.choice([0.99, 4.99, None]), "payment_status": r.choice(["success", "failed"])},
            "banners": {"id": "b", "name": f"n{r.randrange(4)}", "type": "limited"},
        }[table]
        out.append((message(table, row, op, ms),))
    return out


def rows_of(df):
    return sorted(str([None if v is None else round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize(("seed", "deletes"), [(1, 0), (2, 1)])
def test_runs_equal_the_full_build(spark, tmp_path, seed, deletes):
    log = random_log(seed, 360, deletes)
    stamp, honor = F.col("event_timestamp"), bool(deletes)
    for n, part in enumerate((log[:200], log[200:350], log[350:], [])):
        batch = spark.createDataFrame(part, "value string")
        wh = incremental.run_incremental(spark, batch, str(tmp_path), n, honor_deletes=honor, ingested_at=stamp)
    bronze = cdc.to_bronze(spark.createDataFrame(log, "value string"), ingested_at=stamp)[0]
    full = {name: silver.build_silver(bronze, name.removeprefix("stg_"), honor) for name in SILVER_MODELS}
    full |= gold_from(lambda name: full[name])
    for name in (*SILVER_MODELS, *GOLD_MODELS):
        assert set(wh.table(name).columns) == set(full[name].columns)
        assert rows_of(wh.table(name)) == rows_of(full[name]), name
    assert rows_of(wh.table(incremental.HISTORY)) == rows_of(gold.dim_players_scd2(bronze))


def one_pull(key, **more):
    row = {"id": key, "player_id": "1", "rarity": "SSR", "pity_count": 3, "pulled_at": iso(0), "character_id": "ssr-001", "banner_id": "b", "crystals_spent": 160}
    return message("pulls", {**row, **more}, "u" if more else "c", 1000 if more else 0)


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_what_a_run_writes_grows_with_the_change(spark, tmp_path):
    root, stamp = str(tmp_path), F.col("event_timestamp")
    player = {"id": "1", "username": "u", "region": "EU"}
    first = [one_pull(str(i), player_id=str(i % 50)) for i in range(400)]
    incremental.run_incremental(spark, frame(spark, *first, message("players", player, "c", 0)), root, 0, ingested_at=stamp)
    changed = message("pulls", json.loads(one_pull("7"))["payload"]["after"] | {"player_id": "7", "crystals_spent": 320}, "u", 9000)
    wh = incremental.run_incremental(spark, frame(spark, changed), root, 1, ingested_at=stamp)
    for name in ("stg_pulls", "fact_pulls", "player_totals"):
        assert spark.read.parquet(f"{root}/{name}/run=1").count() == 1, name
    for name in ("stg_players", "dim_players", "fact_transactions", incremental.HISTORY):
        assert wh.changes(name, 1) is None
    assert wh.table("fact_pulls").count() == 400 and wh.table("agg_player_spending").where("player_id = '7'").first().total_crystals_spent == 7 * 160 + 320
    # a moved player touches their own pulls only
    wh = incremental.run_incremental(spark, frame(spark, message("players", player | {"region": "NA"}, "u", 9000)), root, 2, ingested_at=stamp)
    assert wh.changes("fact_pulls", 2).count() == 8 and wh.changes("player_totals", 2).count() == 0
    assert {r.player_region for r in wh.table("fact_pulls").where("player_id = '1'").collect()} == {"NA"}
    assert wh.table(incremental.HISTORY).count() == 2


def test_runs_are_published_whole_and_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    wh = incremental.run_incremental(spark, frame(spark, one_pull("p1")), root, 0)
    assert wh.table("stg_players").count() == 0 and wh.table("fact_pulls").first()["player_region"] is None
    with monkeypatch.context() as m:
        m.setattr(incremental.IncrementalWarehouse, "publish", None)
        with pytest.raises(TypeError):
            incremental.run_incremental(spark, frame(spark, one_pull("p2")), root, 1)
    assert wh.table("stg_pulls").count() == wh.table("fact_pulls").count() == 1
    # the next number: what the failed run wrote is not seen
    wh = incremental.run_incremental(spark, frame(spark, one_pull("p3")), root, 2)
    assert {r.id for r in wh.table("stg_pulls").collect()} == {"p1", "p3"} and wh.table("agg_player_spending").first().total_pulls == 2
    assert incremental.run_incremental(spark, frame(spark, one_pull("p4")), root, 2).table("stg_pulls").count() == 2  # published before
    with pytest.raises(ValueError, match="before published"):
        incremental.run_incremental(spark, frame(spark, one_pull("p3")), root, -1)


CHANGES = "player_id string, username string, region string, event_timestamp timestamp, ingested_at timestamp, data string"


def test_history_with_null_regions(spark):
    def versions(*regions):
        rows = [("p", "u", region, dt.datetime(2024, 1, 1 + i), dt.datetime(2024, 1, 1 + i), "{}") for i, region in enumerate(regions)]
        made = gold._versions(spark.createDataFrame(rows, CHANGES).withColumn("known", F.lit(False)))
        return [(r.region, r.valid_from.day, r.valid_to and r.valid_to.day) for r in sorted(made.collect(), key=lambda r: r.valid_from)]

    assert versions("A", None, "B") == [("A", 1, 2), (None, 2, 3), ("B", 3, None)]
    assert versions(None, None) == [(None, 1, None)]
    assert versions("A", "A", None, None, "A") == [("A", 1, 3), (None, 3, 5), ("A", 5, None)]


@pytest.mark.parametrize("seed", [3, 4])
def test_merged_history_equals_the_full_one(spark, seed):
    """Batches of any order and age: late events split versions, or join them."""
    r = random.Random(seed)
    rows = []
    for n in range(160):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(60))
        region = r.choice(["A", "B", None])
        rows.append((str(r.randrange(8)), "u", region, at, at, json.dumps([region, n % 3])))  # as in a log, the row tells its region
    r.shuffle(rows := list(dict.fromkeys(rows)))
    held, seen = None, []
    for part in (rows[:60], rows[60:100], rows[100:]):
        seen += part
        log, batch = spark.createDataFrame(seen, CHANGES), spark.createDataFrame(part, CHANGES)
        made = gold.merge_history(held, log, batch)
        made = spark.createDataFrame(made.collect(), made.schema)
        if held is None:
            held = made.select("key", "row")
        else:
            kept = held.join(made.select("key"), "key", "left_anti")
            held = kept.unionByName(made.select("key", "row").where("row is not null"))
        held = spark.createDataFrame(held.collect(), held.schema)
        full = gold._versions(log.withColumn("known", F.lit(False)))
        assert rows_of(held.select("row.*")) == rows_of(full)


def test_pulls_as_of(spark):
    history = spark.createDataFrame(
        [("p", "A", 1, 3, False), ("p", None, 3, 3, False), ("p", "C", 3, None, True), ("q", "Q", 5, None, True), (None, "N", 1, None, True)],
        "player_id string, region string, f int, t int, is_current boolean",
    ).select("player_id", "region", "is_current", F.timestamp_seconds("f").alias("valid_from"), F.timestamp_seconds("t").alias("valid_to"))
    fact = spark.createDataFrame([("0", "p", 0), ("1", "p", 1), ("2", "p", 2), ("3", "p", 3), ("4", "p", 9), ("5", "q", 4), ("6", None, 9), ("7", "x", 9)], "pull_id string, player_id string, s int")
    got = gold.fact_pulls_asof(fact.select("pull_id", "player_id", F.timestamp_seconds("s").alias("pulled_at")), history)
    assert {r.pull_id: r.region_at_pull for r in got.collect()} == {"0": None, "1": "A", "2": "A", "3": "C", "4": "C", "5": None, "6": None, "7": None}


def test_delta_sums_and_distinct(spark):
    held = spark.createDataFrame([('["a"]', ("a", 5))], "key string, row struct<k string, n bigint>")
    moved = spark.createDataFrame([("a", -5), ("b", 2), ("c", 0), (None, 1)], "k string, n bigint")
    got = {r.row.k: r.row.n for r in delta.patch_sums(held, moved, ["k"], ["n"]).collect()}
    assert got == {"a": 0, "b": 2, None: 1}

"""Silver dedupe, delete semantics and merges."""

import datetime as dt
import json


from cdcmart.operators import merge, silver

T0 = dt.datetime(2024, 1, 1)


def bronze(spark, rows):
    out = []
    for i, (table, event, data) in enumerate(rows):
        ts = T0 + dt.timedelta(minutes=i)
        out.append((data.get("id", "x"), json.dumps(data), event, ts, table, "public", ts))
    return spark.createDataFrame(
        out, "id string, data string, event string, event_timestamp timestamp, source_table string, "
        "source_schema string, ingested_at timestamp"
    )


def test_latest_wins_and_delete_keeps_last_upsert(spark):
    b = bronze(spark, [
        ("pulls", "insert", {"id": "1", "rarity": "R", "is_guaranteed": "true", "pity_count": 3}),
        ("pulls", "update", {"id": "1", "rarity": "SR"}),
        ("pulls", "delete", {"id": "1", "rarity": "SR"}),
        ("pulls", "insert", {"id": "2", "rarity": "SSR"}),
    ])
    r = {x["id"]: x for x in silver.build_silver(b, "pulls").collect()}
    assert r["1"]["rarity"] == "SR" and r["1"]["is_guaranteed"] is False  # missing boolean -> false
    assert r["2"]["rarity"] == "SSR"
    h = {x["id"] for x in silver.build_silver(b, "pulls", honor_deletes=True).collect()}
    assert h == {"2"}


def test_upsert_delete_upsert_again(spark):
    b = bronze(spark, [
        ("pulls", "insert", {"id": "1", "rarity": "R"}),
        ("pulls", "delete", {"id": "1", "rarity": "R"}),
        ("pulls", "insert", {"id": "1", "rarity": "SSR"}),
    ])
    assert [x["rarity"] for x in silver.build_silver(b, "pulls", honor_deletes=True).collect()] == ["SSR"]
    target = silver.build_silver(b, "pulls")
    assert merge.apply_deletes(target, b, ["id"]).count() == 1  # re-insert wins
    assert merge.apply_deletes(target, b, ["id"], order_free=True).count() == 0


def test_composite_key_null_half_and_epoch_days(spark):
    b = bronze(spark, [
        ("player_pity", "insert", {"player_id": "1", "banner_type": "limited", "pity_count": 4}),
        ("player_pity", "insert", {"player_id": "1", "pity_count": 5}),
        ("banners", "insert", {"id": "b1", "type": "limited", "start_date": 20089}),
    ])
    pity = {(x["player_id"], x["banner_type"]): x for x in silver.build_silver(b, "player_pity").collect()}
    assert pity[("1", "limited")]["id"] == "1:limited"
    assert pity[("1", None)]["id"] is None  # concat, not concat_ws
    ban = silver.build_silver(b, "banners").collect()[0]
    assert ban["start_date"] == dt.date(2025, 1, 1) and ban["end_date"] is None


def test_merge_upserts(spark):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    c = spark.createDataFrame([("2", "B", 1), ("2", "BB", 2), ("3", "c", 1)], "id string, v string, o int")
    out = {r["id"]: r["v"] for r in merge.merge_upserts(t, c, ["id"], order=["o"]).collect()}
    assert out == {"1": "a", "2": "BB", "3": "c"}


def test_upsert_increment_and_insert_if_absent(spark):
    inv = spark.createDataFrame([("p", "c1", 5), ("p", "c2", 0), ("p", "c9", 7)], "player_id string, character_id string, constellation int")
    e = spark.createDataFrame(
        [("p", "c1", 0, 1), ("p", "c1", 0, 2), ("p", "c3", 2, 1), ("p", "c4", 0, 1), ("p", "c4", 0, 2), ("p", "c4", 0, 3)],
        "player_id string, character_id string, constellation int, seq int",
    )
    got = {r["character_id"]: r["constellation"] for r in merge.upsert_increment(inv, e).collect()}
    assert got == {"c1": 6, "c2": 0, "c9": 7, "c3": 2, "c4": 2}
    timed = merge.upsert_increment(
        inv.where("character_id <> 'c9'").selectExpr("*", "10 AS obtained_at", "11 AS updated_at"),
        e.withColumn("at", e.seq + 20), time="at",
    )
    got = {r["character_id"]: (r["obtained_at"], r["updated_at"]) for r in timed.collect()}
    assert got == {"c1": (10, 22), "c2": (10, 11), "c3": (21, 21), "c4": (21, 23)}
    t = spark.createDataFrame([("1", "a")], "id string, v string")
    rows = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("2", "z", 1)], "id string, v string, o int")
    got = {r["id"]: r["v"] for r in merge.insert_if_absent(t, rows.select("id", "v", "o"), ["id"], order=["o"]).collect()}
    assert got == {"1": "a", "2": "z"}

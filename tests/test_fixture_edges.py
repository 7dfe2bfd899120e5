"""Hand-made edge rows: tie-breaks, dashboard buckets and tiers, one
violation per quality test kind."""

import datetime as dt
import json

from cdcmart.operators import quality, silver
from cdcmart.plans import bi

T0 = dt.datetime(2024, 1, 1)


def test_equal_ingested_at_tie_break(spark):
    rows = [
        ("1", json.dumps({"id": "1", "rarity": "R"}), "insert", T0, "pulls", "public", T0),
        ("1", json.dumps({"id": "1", "rarity": "SR"}), "update", T0 + dt.timedelta(seconds=1), "pulls", "public", T0),
        ("2", json.dumps({"id": "2", "rarity": "R"}), "insert", T0, "pulls", "public", T0),
        ("2", json.dumps({"id": "2", "rarity": "SSR"}), "update", T0, "pulls", "public", T0),
    ]
    b = spark.createDataFrame(rows, "id string, data string, event string, event_timestamp timestamp, "
                                    "source_table string, source_schema string, ingested_at timestamp")
    got = {r["id"]: r["rarity"] for r in silver.build_silver(b, "pulls").collect()}
    # same ingested_at: later event time wins, then 'update' over 'insert'
    assert got == {"1": "SR", "2": "SSR"}


def _tables(frames):
    return lambda name: frames[name]


def test_pity_buckets_and_spender_tiers(spark):
    pulls = spark.createDataFrame(
        [(str(i), "1", "SSR", p) for i, p in enumerate([0, 10, 11, 73, 74, 89, 90])],
        "pull_id string, player_id string, rarity string, pity_count int",
    )
    got = {r["pity_range"]: r["ssr_pulls"] for r in bi.pity_histogram(_tables({"fact_pulls": pulls})).collect()}
    assert got == {None: 1, "1-10 (early)": 1, "11-30": 1, "51-73": 1, "74-89 (soft pity)": 2, "90 (hard pity)": 1}
    spend = spark.createDataFrame([(str(i), s, 10) for i, s in enumerate([0.0, 49.99, 50.0, 199.99, 200.0])],
                                  "player_id string, total_usd_spent double, total_pulls int")
    tiers = {r["tier"]: r["players"] for r in bi.spender_tiers(_tables({"agg_player_spending": spend})).collect()}
    assert tiers == {"F2P": 1, "Minnow (<$50)": 1, "Dolphin ($50-200)": 2, "Whale ($200+)": 1}


def test_one_violation_per_test_kind(spark):
    fact = spark.createDataFrame(
        [("p1", "u1", "c1", "SSR", T0), ("p1", None, "c9", "XR", T0), ("p3", "u3", None, None, None)],
        "pull_id string, player_id string, character_id string, rarity string, pulled_at timestamp",
    )
    dim = spark.createDataFrame([("c1", "SSR", "n")], "character_id string, rarity string, name string")
    spec = {"fact_pulls": [
        ("pull_id", "unique"), ("player_id", "not_null"), ("character_id", "relationships", "dim_characters",
                                                            "character_id"),
        ("rarity", "accepted_values", ["SSR", "SR", "R"]), ("pulled_at", "not_null"),
    ]}
    res = {(r["column"], r["test"]): r["failures"] for r in
           quality.run_checks(_tables({"fact_pulls": fact, "dim_characters": dim}), spec).collect()}
    assert res == {("pull_id", "unique"): 1, ("player_id", "not_null"): 1, ("character_id", "relationships"): 1,
                   ("rarity", "accepted_values"): 1, ("pulled_at", "not_null"): 1}

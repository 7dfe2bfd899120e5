"""Segmented scans equal plain windows, including a key with most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cdcmart.operators.scan import segmented_scan


def test_scan_matches_window(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}"
        v = rnd.choice([None, 1, 2, 5, -3])
        rows.append((k, i, v))
    df = spark.createDataFrame(rows, "k string, t long, v int")
    specs = {
        "c_inc": ("count", None, True),
        "c_exc": ("count", None, False),
        "s_inc": ("sum", F.col("v"), True),
        "m_exc": ("max", F.col("v"), False),
        "l_exc": ("last", F.col("v"), False),
        "l_inc": ("last", F.col("v"), True),
        "p_exc": ("lastpos", F.col("v") == 5, False),
        "p_inc": ("lastpos", F.col("v") == 5, True),
    }
    got = {r["t"]: r for r in segmented_scan(df, ["k"], ["t"], specs, partitions=7).collect()}
    w = Window.partitionBy("k").orderBy("t")
    inc, exc = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("_rn", F.row_number().over(w)).select(
        "t",
        F.count(F.lit(1)).over(inc).alias("c_inc"),
        F.coalesce(F.count(F.lit(1)).over(exc), F.lit(0)).alias("c_exc"),
        F.sum("v").over(inc).alias("s_inc"),
        F.max("v").over(exc).alias("m_exc"),
        F.last("v", ignorenulls=True).over(exc).alias("l_exc"),
        F.last("v", ignorenulls=True).over(inc).alias("l_inc"),
        F.max(F.when(F.col("v") == 5, F.col("_rn"))).over(exc).alias("p_exc"),
        F.max(F.when(F.col("v") == 5, F.col("_rn"))).over(inc).alias("p_inc"),
    ).collect()
    assert len(got) == len(ref)
    for r in ref:
        g = got[r["t"]]
        for c in specs:
            assert g[c] == r[c], (r["t"], c, g[c], r[c])


def test_scd2_versions(spark):
    import datetime as dt
    import json

    from cdcmart.operators.gold import dim_players_scd2

    t0 = dt.datetime(2024, 1, 1)
    ev = [("1", "EU"), ("1", "EU"), ("1", "NA"), ("2", "ASIA"), ("1", "EU")]
    rows = [(p, json.dumps({"id": p, "region": r, "username": "u" + p}), "update", t0 + dt.timedelta(hours=i), "players",
             "public", t0 + dt.timedelta(hours=i)) for i, (p, r) in enumerate(ev)]
    b = spark.createDataFrame(rows, "id string, data string, event string, event_timestamp timestamp, "
                                    "source_table string, source_schema string, ingested_at timestamp")
    got = sorted((r["player_id"], r["region"], r["valid_from"].hour, r["valid_to"].hour if r["valid_to"] else None)
                 for r in dim_players_scd2(b).collect())
    assert got == [("1", "EU", 0, 2), ("1", "EU", 4, None), ("1", "NA", 2, 4), ("2", "ASIA", 3, None)]


def test_global_rank_hot_group(spark):
    from cdcmart.operators.stats import global_rank

    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r["g"], r["rank"], r["v"]) for r in global_rank(df, "v", "g", partitions=7).collect())
    w = Window.partitionBy("g").orderBy("v")
    want = sorted((r["g"], r["rank"], r["v"]) for r in df.select("g", "v", F.row_number().over(w).alias("rank")).collect())
    assert got == want

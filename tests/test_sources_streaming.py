"""Seed loader, stable keys, DLQ JSON, and streaming helpers."""

import datetime as dt
import json
import os
import tempfile


import pytest

from cdcmart.operators import cdc
from cdcmart.sources import files
from cdcmart.streaming import cdc_stream as cs


def test_load_seed(spark, tmp_path):
    doc = {
        "characters": [{"id": "ssr-001", "name": "A", "rarity": "SSR", "visual": {"portrait": "p/a.webp"}}],
        "banners": [{"id": "b1", "type": "limited", "rate_up_ssr": "ssr-001"}],
        "topup_packages": [{"id": "pkg-01", "crystals": 60, "price_usd": 0.99}],
        "gacha_config": {"ssr_base_rate": 0.015, "ssr_hard_pity": 90},
    }
    p = tmp_path / "seed.json"
    p.write_text(json.dumps(doc, indent=2))
    t = files.load_seed(spark, str(p))
    assert t["characters"].first()["portrait"] == "p/a.webp"
    assert t["banners"].first()["rate_up_ssr_id"] == "ssr-001"
    cfg = {r["key"]: r["value"] for r in t["gacha_config"].collect()}
    assert cfg == {"ssr_base_rate": 0.015, "ssr_hard_pity": 90.0}


def test_stable_keys_and_dlq_json(spark, tmp_path):
    m = {"payload": {"after": {"player_id": "1", "banner_type": "limited", "pity_count": 2},
                     "source": {"schema": "public", "table": "player_pity"}, "op": "u", "ts_ms": 1}}
    bad = {"payload": {"after": {}, "source": {"schema": "public", "table": "x"}, "op": "c", "ts_ms": 1}}
    df = spark.createDataFrame([(json.dumps(m),), (json.dumps(bad),)], "value string")
    r = cdc.route(df, stable_keys={"player_pity": ["player_id", "banner_type"]}).collect()
    assert r[0]["id"] == "1:limited"
    out = str(tmp_path / "dlq")
    files.write_dlq_json(spark.createDataFrame([(x["reason"], x["raw"]) for x in r if x["route"] == "dlq"],
                                               "reason string, raw string"), out)
    lines = [json.loads(x["value"]) for x in spark.read.text(out).collect()]
    assert lines[0]["reason"] == "op='c' missing payload.after"


def test_stream_helpers(spark):
    base = tempfile.mkdtemp(prefix="cdcmart-test-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("1", "{}", "insert", t0 + dt.timedelta(minutes=10 * i), "pulls", "public", t0) for i in range(12)]
    rows.append(rows[0])  # duplicate delivery
    df = spark.createDataFrame(rows, "id string, data string, event string, event_timestamp timestamp, "
                                     "source_table string, source_schema string, ingested_at timestamp")
    df.write.parquet(os.path.join(base, "in"))
    schema = df.schema
    s = spark.readStream.schema(schema).parquet(os.path.join(base, "in"))
    q = (cs.dedupe_deliveries(s).writeStream.format("memory").queryName("dedup_t").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "c1")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("dedup_t").count() == 12
    q = (cs.volume(spark.readStream.schema(schema).parquet(os.path.join(base, "in"))).writeStream.format("memory")
         .queryName("vol_t").outputMode("complete").option("checkpointLocation", os.path.join(base, "c2"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["window_start"].hour: r["events"] for r in spark.table("vol_t").collect()}
    assert got == {0: 7, 1: 6}


def test_pandas_stateful_watchlist(spark):
    from cdcmart.streaming import watchlist as wl

    base = tempfile.mkdtemp(prefix="cdcmart-watch-")
    rows = [(1, 0, "r1", "subscribe"), (2, 0, "r2", "subscribe"), (3, 0, "r2", "unsubscribe"), (4, 1, "r1", "subscribe"),
            (5, 0, "r2", "subscribe"), (6, 1, "r1", "unsubscribe"), (2, 0, "r2", "subscribe")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "seq long, client_id long, repo string, op string").write.parquet(f"{base}/in/{i}")
    cmds = spark.readStream.schema("seq long, client_id long, repo string, op string").option(
        "maxFilesPerTrigger", "2").option("recursiveFileLookup", "true").parquet(f"{base}/in")
    q = (wl.watchlist_updates(cmds).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    st = {(r["client_id"], r["repo"]) for r in wl.current_state(spark.read.parquet(f"{base}/out")).collect()}
    assert st == {(0, "r1"), (0, "r2")}


def test_bronze_sink_progress_metrics(spark):
    base = tempfile.mkdtemp(prefix="cdcmart-sink-")
    good = {"payload": {"after": {"id": "1"}, "source": {"schema": "s", "table": "pulls"}, "op": "c", "ts_ms": 1}}
    bad = {"payload": {"after": {}, "source": {"schema": "s", "table": "pulls"}, "op": "c", "ts_ms": 1}}
    vals = [json.dumps(good).encode(), json.dumps(bad).encode(), b"\xff\xfe"]
    spark.createDataFrame([(v,) for v in vals], "value binary").write.parquet(f"{base}/in")
    q = cs.bronze_sink(cs.read_cdc(spark, f"{base}/in", fmt="binary"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    m = q.lastProgress["observedMetrics"]["cdc_progress"]
    assert (m["messages"], m["bronze"], m["dlq"], m["undecodable"]) == (3, 1, 1, 1)
    routes = {r["route"] for r in spark.read.parquet(f"{base}/out").select("route").collect()}
    assert routes == {"bronze", "dlq", "undecodable"}


def test_fingerprint_follows_the_files(spark, tmp_path, monkeypatch):
    from cdcmart.sources import tables
    from cdcmart.sources.tables import fingerprint

    monkeypatch.setattr(tables, "LISTED_SECONDS", 0.0)

    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    before = fingerprint(spark, str(tmp_path))
    assert fingerprint(spark, str(tmp_path)) == before
    spark.range(3).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert fingerprint(spark, str(tmp_path)) != before

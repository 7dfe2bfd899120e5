"""What keeps the streaming and incremental queries in proportion to their input."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F


def test_live_fanout_calls_do_not_grow_with_repos(spark, tmp_path):
    """Many repos (a null one too) share the groups of the state; every tick still goes
    to the clients of its own repo once."""
    from cdcmart.streaming import watchlist as wl

    start = dt.datetime(2024, 1, 1)
    repos = [None, *(f"r{i}" for i in range(40))]
    for n in range(2):
        at = start + dt.timedelta(hours=n)
        commands = [(at, 100 * n + i, i % 5 + n, r, "subscribe" if i % 4 else "unsubscribe") for i, r in enumerate(repos)]
        ticks = [(at + dt.timedelta(minutes=1), 1000 * n + i, r, i, "gone" if i % 7 == 6 else None) for i, r in enumerate(repos)]
        spark.createDataFrame(commands, "at timestamp, seq long, client_id long, repo string, op string").write.parquet(f"{tmp_path}/c/n={n}")
        spark.createDataFrame(ticks, "at timestamp, tick_id long, repo string, price long, error string").write.parquet(f"{tmp_path}/t/n={n}")
        read = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{k}").schema).parquet(f"{tmp_path}/{k}") for k in "ct"]
        made = wl.live_fanout(*read, buckets=2, slots=3)
        w = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        w.trigger(availableNow=True).start().awaitTermination()
    want = [
        (1000 * n + i, r, i % 5 + m, "error" if i % 7 == 6 else "tick", None if i % 7 == 6 else i, "gone" if i % 7 == 6 else None)
        for n in range(2) for m in range(n + 1) for i, r in enumerate(repos) if i % 4
    ]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("tick_id", "repo", "client_id", "kind", "price", "message").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spark.read.format("statestore").load(f"{tmp_path}/ck").count() <= 3


def test_replay_makes_its_deliveries_once(spark, tmp_path):
    """The slices are handed out of one pass over the deliveries, not one pass each."""
    from cdcmart.plans import q_stream as qs

    made = spark.sparkContext.accumulator(0)

    def passed(n):
        made.add(1)
        return n

    rows = spark.range(40).select(F.udf(passed, "long")("id").alias("n"), (F.col("id") % 4).cast("int").alias("delivered"))
    seen = []

    def start(stream):
        seen.append(1)
        w = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        return w.trigger(availableNow=True).start()

    qs._replay(rows, str(tmp_path / "run"), start)
    assert len(seen) == 4 and made.value == 40
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_message_log_splits_and_lies_by_run(spark, tmp_path, monkeypatch):
    """A written log has small row groups, and a folder per run that reads its own only."""
    import pyarrow.parquet as pq

    from cdcmart.sources import adapter

    monkeypatch.setattr(adapter, "LOG_ROW_GROUP", 1 << 20)
    text = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(8)])
    rows = spark.range(0, 12_000, 1, 1).select(F.encode(text, "UTF-8").alias("value"), (F.col("id") % 2).cast("int").alias("batch"))
    adapter.write_messages(rows, f"{tmp_path}/m", ("batch",))
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "m") for f in names if f.endswith(".parquet")]
    assert len(files) == 2 and all(pq.ParquetFile(f).num_row_groups > 1 for f in files)
    read = spark.read.schema(rows.schema).parquet(f"{tmp_path}/m")
    assert len({r[0] for r in read.where("batch = 1").select(F.input_file_name()).distinct().collect()}) == 1
    assert read.exceptAll(rows).count() == 0 and read.count() == 12_000


def test_micro_batches_do_not_grow_with_files(spark, tmp_path):
    """An input of many small files is taken in a bounded number of micro-batches."""
    from cdcmart.plans import q_stream as qs

    spark.range(0, 60, 1, 60).select(F.col("id").cast("string").alias("id"), F.lit("bronze").alias("route")).write.parquet(f"{tmp_path}/out")
    stream = qs._bronze_stream(spark, str(tmp_path), 2).select("id")
    seen = []
    q = stream.writeStream.foreachBatch(lambda rows, n: seen.append(rows.count())).option("checkpointLocation", f"{tmp_path}/ck")
    q.trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 60 and 1 < len(seen) <= qs.MAX_BATCHES

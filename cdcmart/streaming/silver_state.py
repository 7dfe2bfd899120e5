"""Silver as keyed state of a stream.

The latest change of every key of every table lives in Spark's own state store:
partitioned by key, checkpointed with the stream, restored on restart. Two forms:

latest    a streaming aggregate, ``max`` over (ingest time, event time, kind, row) per
          (table, key), JVM-side; deletes are left out before ranking (C1), or ranked too,
          then a key whose latest change is a delete stays as a tombstone
expiring  ``applyInPandasWithState``: the same latest change, deletes ranked too; a
          tombstone leaves the state a ``retention`` of ingest time after its delete, by an
          event-time timer. A Python call per key and micro-batch: for logs in which
          tombstones would pile up

Change order travels with the state, so micro-batches out of order keep the latest row.
:func:`silver_table` reads a Silver table out of the committed state with Spark's state
data source; ``changes`` appends each micro-batch's touched keys to a folder of its own,
overwritten when a batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cdcmart.operators import silver
from cdcmart.schemas import SILVER_SPECS

# FIXED VALUES: default merge interval of the Silver merge.
MERGE_EVERY = "2 minutes"

#: State of large tables belongs on local disk, not on the heap; a session's own choice wins.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = "ingested_us long, event_us long, event string, data string"
_CHANGES = f"source_table string, key string, {_STATE}"


def state_key(tables: Sequence[str] | None = None) -> Column:
    """The Silver key of a Bronze row as JSON text of its key fields (a missing half
    of a composite key is a null in it)."""
    specs = [SILVER_SPECS[t] for t in (tables or SILVER_SPECS)]
    fields = list(dict.fromkeys(k for s in specs for k in s.keys))
    parsed = F.from_json("data", T.StructType([T.StructField(k, T.StringType()) for k in fields]))
    key = F.lit(None).cast("array<string>")
    for spec in specs:
        key = F.when(F.col("source_table") == spec.table, F.array(*[parsed[k] for k in spec.keys])).otherwise(key)
    return F.to_json(key)


def _known(bronze: DataFrame, tables: Sequence[str] | None) -> DataFrame:
    return bronze.where(F.col("source_table").isin(*(tables or SILVER_SPECS))).withColumn("key", state_key(tables))


def latest(bronze: DataFrame, tables: Sequence[str] | None = None, honor_deletes: bool = False) -> DataFrame:
    """The latest insert or update (or delete) per (table, key); a stream keeps it
    as state."""
    rows = silver.keep_upserts(_known(bronze, tables), honor_deletes)
    return rows.groupBy("source_table", "key").agg(F.max(F.struct(*silver.DEFAULT_ORDER)).alias("latest"))


def _keep_latest(retention_ms: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        best = held
        for rows in batches:
            top = max(zip(*[rows[c].tolist() for c in ("ingested_us", "event_us", "event", "data")], strict=True))
            best = top if best is None or top > best else best
        if best == held:
            return
        state.update(best)
        if best[2] == "delete":  # a later change of the key replaces the timer
            state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + retention_ms)
        yield pd.DataFrame([(*key, *best)], columns=["source_table", "key", "ingested_us", "event_us", "event", "data"])

    return run


def expiring(bronze: DataFrame, retention_ms: int, tables: Sequence[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """B9 on a stream with tombstones that end: changes that became the latest of their
    key, deletes among them.

    ``delay`` is how far ``ingested_at`` may fall behind the newest seen (rows beyond
    it are dropped: set it to what the log's disorder needs); a tombstone is forgotten
    ``retention_ms`` of ingest time after its delete, from when on an older change of
    that key would be taken as new."""
    rows = _known(bronze, tables).withWatermark("ingested_at", delay).select(
        "ingested_at", "source_table", "key", F.unix_micros("ingested_at").alias("ingested_us"),
        F.unix_micros("event_timestamp").alias("event_us"), "event", "data",
    )
    return rows.groupBy("source_table", "key").applyInPandasWithState(
        _keep_latest(retention_ms), _CHANGES, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def _append_changes(folder: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def merge_sink(bronze: DataFrame, checkpoint: str, every: str | None = MERGE_EVERY, tables: Sequence[str] | None = None,
               honor_deletes: bool = False, changes: str | None = None, retention_ms: int | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Keep Silver as the state of a stream that runs every ``every`` (processing
    time); ``every=None`` drains what is available and stops. The checkpoint is the
    table: a restart with it goes on where it was. ``changes`` (a folder) also gets the
    touched keys of each micro-batch. ``retention_ms`` (with ``delay``): deletes count and
    their tombstones end, see :func:`expiring`."""
    spark = bronze.sparkSession
    if spark.conf.get(_PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    rows = latest(bronze, tables, honor_deletes) if retention_ms is None else expiring(bronze, retention_ms, tables, delay)
    w = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    w = w.foreachBatch(_append_changes(changes)) if changes else w.format("noop")
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The committed state: ``source_table``, ``key`` and the latest change's columns."""
    rows = spark.read.format("statestore").load(checkpoint)
    if "groupState" in rows.schema["value"].dataType.names:
        held = F.col("value.groupState")
        order = [F.timestamp_micros(held["ingested_us"]).alias("ingested_at"), F.timestamp_micros(held["event_us"]).alias("event_timestamp"),
                 held["event"].alias("event"), held["data"].alias("data")]
    else:
        order = [F.col(f"value.max.{c}").alias(c) for c in silver.DEFAULT_ORDER]
    return rows.select("key.source_table", "key.key", *order)


def silver_table(spark: SparkSession, checkpoint: str, table: str) -> DataFrame:
    """The Silver table ``table`` as the stream of ``checkpoint`` holds it, without
    tombstones."""
    rows = state(spark, checkpoint).where(F.col("source_table") == table)
    return silver.typed_rows(rows.where(F.col("event") != "delete"), SILVER_SPECS[table])

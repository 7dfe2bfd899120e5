"""Structured Streaming CDC ingest (A1, A3, A4, B12-B14; Silver: ``silver_state``).

read_cdc     -> a stream of raw messages (file source; Kafka by option)
bronze_sink  -> route() every micro-batch into Bronze / DLQ / undecodable
                folders with one partitioned file-sink write (exactly once
                through the checkpoint)
volume       -> events per table and kind in tumbling event-time windows
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cdcmart.operators import cdc
from cdcmart.schemas import SILVER_SPECS
from cdcmart.session import work_dir


def read_cdc(spark: SparkSession, path: str | None = None, fmt: str = "text", kafka: dict | None = None,
             max_files: int | None = None) -> DataFrame:
    """A1: raw messages as a stream with a ``value`` column.

    ``fmt='text'``: one JSON message per line; ``fmt='binary'``: parquet
    files with a binary ``value`` column; ``kafka``: options for the Kafka
    source (needs the Kafka connector on the classpath).
    """
    if kafka is not None:
        r = spark.readStream.format("kafka")
        for k, v in kafka.items():
            r = r.option(k, v)
        return r.load().select("value")
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    if fmt == "text":
        return r.format("text").load(path)
    return r.schema("value binary").parquet(path)


def routed(stream: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """B1-B4 on a stream, plus B12 progress metrics via ``observe``."""
    r = cdc.route(stream, ingested_at=ingested_at, tables=list(SILVER_SPECS))
    return r.observe(
        "cdc_progress",
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("route") == "bronze").alias("bronze"),
        F.count_if(F.col("route") == "dlq").alias("dlq"),
        F.count_if(F.col("route") == "undecodable").alias("undecodable"),
    )


def bronze_sink(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None,
                ingested_at: Column | None = None, grain: str = "day") -> StreamingQuery:
    """A3/A4: append every routed message to ``out/route=.../source_table=.../ingest_date=...``."""
    w = (
        cdc.with_ingest_date(routed(stream, ingested_at), grain)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*cdc.LOG_PARTITIONS)
        .outputMode("append")
    )
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def dead_letter_sink(dead_letters: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A4: dead letters (``reason``, ``raw``) appended as JSON lines."""
    w = (
        dead_letters.select(F.to_json(F.struct("reason", "raw")).alias("value"))
        .writeStream.format("text")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_bronze_stream(spark: SparkSession, out: str) -> DataFrame:
    """Bronze rows of a bronze sink folder, as a stream."""
    schema = (
        "id string, data string, event string, event_timestamp timestamp, source_schema string, "
        "reason string, raw string, ingested_at timestamp, route string, source_table string, ingest_date date"
    )
    return (
        spark.readStream.schema(schema)
        .option("basePath", out)
        .parquet(f"{out}/route=bronze")
        .select(*cdc.BRONZE_COLS)
    )


def dedupe_deliveries(bronze: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop duplicate deliveries of the same change within the watermark."""
    return bronze.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(
        ["id", "source_table", "event_timestamp", "event"]
    )


def volume(bronze: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per (window, table, kind); append mode emits closed windows."""
    return (
        bronze.withWatermark("event_timestamp", delay)
        .groupBy(F.window("event_timestamp", window), "source_table", "event")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "source_table",
            "event",
            "events",
        )
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def sessions(events: DataFrame, gap: str = "24 hours", key: str = "user_id", ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """H7 on a stream: sliding-expiry sessions per key with ``session_window`` (a
    session closes ``gap`` after its last event). The state holds the sessions that the
    watermark, ``delay`` behind the newest event, has not passed; append mode emits a
    session once, when it is closed."""
    return (
        events.withColumn("_t", F.col(ts).cast("timestamp"))
        .withWatermark("_t", delay)
        .groupBy(F.col(key).alias("session_key"), F.session_window("_t", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("writes"))
        .select("session_key", F.col("s.start").alias("session_start"), F.col("s.end").alias("expires_at"), "writes")
    )


class LateGate:
    """Side output of late rows: a ``foreachBatch`` function that writes every
    micro-batch as ``on_time/batch=<id>`` and ``late/batch=<id>`` under ``root``.

    A row is late where ``ends`` (the end of what it would be counted in; by default its
    event time) is not after the watermark of its batch: ``delay`` behind the newest
    event time of all *earlier* batches, in whole milliseconds, as Spark's own event-time
    operators judge it. The newest time of each batch is kept beside its rows, so a
    replayed batch is judged, and overwritten, the same way.
    """

    def __init__(self, root: str, time: str = "event_timestamp", delay_ms: int = 600_000, ends: Column | None = None):
        self.root, self.time, self.delay_ms = root.rstrip("/"), time, delay_ms
        self.ends = F.col(time) if ends is None else ends

    def watermark(self, spark: SparkSession, batch_id: int) -> int:
        """Watermark of a batch in epoch milliseconds; 0 before the first batch."""
        if not batch_id:
            return 0
        seen = spark.read.schema("newest long, batch long").parquet(f"{self.root}/seen").where(F.col("batch") < batch_id)
        return max(0, seen.agg(F.max("newest")).first()[0] - self.delay_ms)  # one row per batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = F.timestamp_millis(F.lit(self.watermark(spark, batch_id)))
        judged = batch.withColumn("late", self.ends <= mark).withColumn("watermark", mark)
        judged.write.mode("overwrite").partitionBy("late").parquet(f"{self.root}/rows/batch={batch_id}")
        newest = batch.agg(F.coalesce(F.max(F.unix_millis(self.time)), F.lit(0)).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{self.root}/seen/batch={batch_id}")

    def read(self, spark: SparkSession, late: bool) -> DataFrame:
        rows = spark.read.option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows")
        return rows.where(F.col("late") == late).drop("late")


class ProgressListener:
    """Collects the ``cdc_progress`` metrics of every micro-batch.

    Register with ``spark.streams.addListener(ProgressListener.create())``;
    ``batches`` holds (batch id, metrics dict) in arrival order; ``table`` makes a
    table of them (one row per micro-batch) once the query has ended.
    """

    COUNTS = ("messages", "bronze", "dlq", "undecodable")

    @staticmethod
    def create():
        from pyspark.sql.streaming import StreamingQueryListener

        class _L(StreamingQueryListener):
            def __init__(self):
                self.batches = []
                self.ended = threading.Event()

            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                m = event.progress.observedMetrics.get("cdc_progress")
                if m is not None:
                    self.batches.append((event.progress.batchId, m.asDict()))

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                self.ended.set()

            def table(self, spark: SparkSession, query: StreamingQuery, wait: float = 30.0) -> DataFrame:
                if not query.isActive:  # progress events come before the end event
                    self.ended.wait(wait)
                rows = [(str(query.id), b, *[m[c] for c in ProgressListener.COUNTS]) for b, m in self.batches]
                return spark.createDataFrame(rows, "query string, batch long, " + ", ".join(f"{c} long" for c in ProgressListener.COUNTS))

        return _L()

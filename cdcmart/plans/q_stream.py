"""Registered streaming queries: each replays data derived from the driver
tables through a Structured Streaming query (availableNow, several
micro-batches) into a fresh folder under the shared checkpoint folder and
returns the final table; the twin is the batch SQL of the same result."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.operators import silver, ticker
from cdcmart.plans.q_misc import TICK_FANOUT_SQL, W_STATE
from cdcmart.plans.registry import register
from cdcmart.schemas import SILVER_SPECS
from cdcmart.sources import adapter
from cdcmart.sources.tables import fingerprint, load
from cdcmart.streaming import cdc_stream as cs
from cdcmart.streaming import silver_state as ss
from cdcmart.streaming import watchlist as wl

ROUTED_SCHEMA = (
    "route string, id string, data string, event string, event_timestamp timestamp, source_table string, "
    "source_schema string, reason string, raw string, ingested_at timestamp, ingest_date date"
)


_INGESTED: dict[tuple, str] = {}


def _input_key(spark, sf_dir) -> tuple:
    return os.path.realpath(sf_dir), fingerprint(spark, sf_dir), cs.work_dir(spark)


#: A replay takes about so many micro-batches at most, however many files its input has.
MAX_BATCHES = 8


def _per_batch(spark, path: str, schema: str, files: int) -> int:
    """Files of a micro-batch: ``files``, more where the input would make over
    :data:`MAX_BATCHES` batches of them."""
    return max(files, -(-len(spark.read.schema(schema).parquet(path).inputFiles()) // MAX_BATCHES))


def _ingest(spark, sf_dir, files_per_batch: int = 16):
    """Message log -> files -> streaming Bronze sink. Returns the base folder.

    The ingested Bronze folder is shared by the downstream streaming queries
    of this session (each still runs its own streaming query over it)."""
    key = _input_key(spark, sf_dir)
    if key in _INGESTED:
        return _INGESTED[key]
    base = cs.scratch(spark, "stream")
    msgs = adapter.cdc_messages(adapter.source_tables(spark, sf_dir))
    adapter.write_messages(msgs, f"{base}/in")
    s = cs.read_cdc(spark, f"{base}/in", fmt="binary", max_files=_per_batch(spark, f"{base}/in", "value binary", files_per_batch))
    listener = cs.ProgressListener.create()
    spark.streams.addListener(listener)
    q = cs.bronze_sink(s, f"{base}/out", f"{base}/ckpt_bronze", ingested_at=F.col("event_timestamp"), grain="year")
    q.awaitTermination()
    listener.table(spark, q).write.parquet(f"{base}/progress")
    spark.streams.removeListener(listener)
    _INGESTED[key] = base
    return base


def _fresh(base: str, name: str) -> str:
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:8]}"


def _routed_stream(spark, base, files_per_batch: int = 16):
    """The routed log as a stream."""
    files = _per_batch(spark, f"{base}/out", ROUTED_SCHEMA, files_per_batch)
    return spark.readStream.schema(ROUTED_SCHEMA).option("maxFilesPerTrigger", str(files)).parquet(f"{base}/out")


def _bronze_stream(spark, base, files_per_batch: int = 16):
    return _routed_stream(spark, base, files_per_batch).where(F.col("route") == "bronze")


@register(
    "stream_bronze",
    "SELECT id, event, event_timestamp, source_table, source_schema FROM bronze_keys",
)
def q_stream_bronze(spark, sf_dir):
    """Streaming ingest of the CDC message files into Bronze."""
    _INGESTED.pop(_input_key(spark, sf_dir), None)  # always a new ingest
    base = _ingest(spark, sf_dir)
    out = spark.read.parquet(f"{base}/out")  # committed files only (sink log)
    return out.where(F.col("route") == "bronze").select("id", "event", "event_timestamp", "source_table", "source_schema")


@register("stream_merge", "SELECT * FROM stg_pulls")
def q_stream_merge(spark, sf_dir):
    """Silver pulls as the keyed state of the Bronze stream."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "merge")
    ss.merge_sink(_bronze_stream(spark, base, 12), f"{run}/ckpt", every=None, tables=["pulls"]).awaitTermination()
    return ss.silver_table(spark, f"{run}/ckpt", "pulls")


#: Tables of the merge.
MERGED = ("pulls", "transactions", "players", "player_pity", "player_inventory", "characters", "banners")


@register("stream_merge_tables", "\nUNION ALL BY NAME ".join(f"SELECT '{t}' AS \"table\", * FROM stg_{t}" for t in MERGED))
def q_stream_merge_tables(spark, sf_dir):
    """The whole rows of all seven tables, read out of the stream's state; the
    stream is stopped and started again with its checkpoint on the way."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "merge-tables")
    for files in (64, 24):
        q = ss.merge_sink(_bronze_stream(spark, base, files), f"{run}/ckpt", every=None if files == 24 else "0 seconds")
        while files == 64 and q.isActive and not q.recentProgress:
            q.awaitTermination(0.2)
        q.stop() if files == 64 else q.awaitTermination()
    held = ss.state(spark, f"{run}/ckpt")
    parts = [silver.typed_rows(held.where(F.col("source_table") == t), SILVER_SPECS[t]).select(F.lit(t).alias("table"), "*") for t in MERGED]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@register("stream_merge_deletes", "SELECT * FROM stg_pulls WHERE CAST(id AS BIGINT) % 17 <> 0")
def q_stream_merge_deletes(spark, sf_dir):
    """B9 in streaming: deletes kept as tombstones, hidden from the table."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "merge-deletes")
    ss.merge_sink(_bronze_stream(spark, base, 12), f"{run}/ckpt", every=None, tables=["pulls"], honor_deletes=True).awaitTermination()
    return ss.silver_table(spark, f"{run}/ckpt", "pulls")


# --- event time that moves ---------------------------------------------------
#
# The log is delivered in event order, in slices by day of January 2024, one micro-batch
# each; the streams are stopped between slices and go on from their checkpoints. Some
# changes come a slice too late (every 25th pull), and so do repeated deliveries.

SLICE_DAYS = (8, 15, 23)
DELAY_MS = 2 * 86_400_000
_DELIVERED = """
    (SELECT *, least(slice + if(is_late OR copy > 1, 1, 0), 3) AS delivered
     FROM (SELECT *, CASE WHEN event_timestamp < TIMESTAMP '2024-01-09' THEN 0 WHEN event_timestamp < TIMESTAMP '2024-01-16' THEN 1
                          WHEN event_timestamp < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END AS slice,
                  source_table = 'pulls' AND try_cast(id AS BIGINT) % 25 = 3 AS is_late,
                  row_number() OVER (PARTITION BY source_table, id, event, event_timestamp) AS copy
           FROM bronze_keys))"""
# rows with the watermark (epoch ms) of the micro-batch that delivered them
_MARKED = f"""
    (SELECT d.*, coalesce((SELECT max(epoch_ms(event_timestamp)) - {DELAY_MS} FROM {_DELIVERED} e WHERE e.delivered < d.delivered), 0) AS mark
     FROM {_DELIVERED} d)"""
_FINAL_MARK = f"(SELECT max(epoch_ms(event_timestamp)) - {DELAY_MS} FROM bronze_keys)"


def _slices(rows: DataFrame, time: str) -> DataFrame:
    day = [F.lit(f"2024-01-{d + 1:02d}").cast("timestamp") for d in SLICE_DAYS]
    at = F.col(time)
    return rows.withColumn("slice", F.when(at < day[0], 0).when(at < day[1], 1).when(at < day[2], 2).otherwise(3))


def _deliveries(spark, base) -> DataFrame:
    """The Bronze rows of the log with the slice that delivers them."""
    rows = _slices(spark.read.parquet(f"{base}/out").where(F.col("route") == "bronze"), "event_timestamp")
    key = ["source_table", "id", "event", "event_timestamp"]
    copies = rows.groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("n"))
    each = copies.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    late = (F.col("source_table") == "pulls") & (F.expr("try_cast(id AS bigint)") % 25 == 3)
    return each.select(*key, F.least(F.col("slice") + F.when(late | (F.col("copy") > 1), 1).otherwise(0), F.lit(3)).alias("delivered"))


def _replay(deliveries: DataFrame, run: str, start) -> None:
    """Write the slices one after another; drain each with a stream of its own start. The
    deliveries are made once, dealt into a folder per slice, and handed out from there."""
    columns = [c for c in deliveries.columns if c != "delivered"]
    spark, schema = deliveries.sparkSession, deliveries.select(*columns).schema
    deliveries.write.partitionBy("delivered").parquet(f"{run}/all")
    made = spark.read.schema(deliveries.schema).parquet(f"{run}/all")
    for n in range(len(SLICE_DAYS) + 1):
        made.where(F.col("delivered") == n).select(*columns).write.parquet(f"{run}/in/slice={n}")
        stream = spark.readStream.schema(schema).option("basePath", f"{run}/in").parquet(f"{run}/in")
        start(stream.select(*columns)).awaitTermination()


def _appending(run, make):
    """Start of a stream that appends ``make(input)`` to a folder."""
    def start(stream):
        return (
            make(stream).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/ckpt")
            .outputMode("append").trigger(availableNow=True).start()
        )

    return start


_HOURLY = """SELECT time_bucket(INTERVAL 1 HOUR, event_timestamp) AS window_start,
           time_bucket(INTERVAL 1 HOUR, event_timestamp) + INTERVAL 1 HOUR AS window_end,
           source_table, event, count(*) AS events"""


def _hourly_sql(closed: bool) -> str:
    having = f"HAVING epoch_ms(window_end) <= {_FINAL_MARK}" if closed else ""
    return f"""
    {_HOURLY} FROM {_MARKED}
    WHERE epoch_ms(time_bucket(INTERVAL 1 HOUR, event_timestamp)) + 3600000 > mark
    GROUP BY 1, 2, source_table, event {having}"""


@register("stream_volume", _hourly_sql(False))
def q_stream_volume(spark, sf_dir):
    """Hourly event volume per table and kind with its watermark, in update mode:
    the last count of every hour, those still open among them; rows behind the
    watermark are not counted."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "volume")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={batch_id}")

    def start(stream):
        counts = cs.volume(stream, delay=f"{DELAY_MS} milliseconds")
        return counts.writeStream.foreachBatch(write).option("checkpointLocation", f"{run}/ckpt").outputMode("update").trigger(availableNow=True).start()

    _replay(_deliveries(spark, base), run, start)
    keys = ["window_start", "window_end", "source_table", "event"]
    return spark.read.parquet(f"{run}/out").groupBy(*keys).agg(F.max_by("events", "batch").alias("events"))


@register("stream_volume_closed", _hourly_sql(True))
def q_stream_volume_closed(spark, sf_dir):
    """B14 in append mode: each hour once, when the watermark has passed it."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "volume-closed")
    _replay(_deliveries(spark, base), run, _appending(run, lambda s: cs.volume(s, delay=f"{DELAY_MS} milliseconds")))
    return spark.read.parquet(f"{run}/out")


@register(
    "stream_dedupe_deliveries",
    f"SELECT DISTINCT id, event, event_timestamp, source_table FROM {_MARKED} WHERE epoch_us(event_timestamp) > mark * 1000",
)
def q_stream_dedupe(spark, sf_dir):
    """Changes delivered more than once, in one micro-batch or in two, are kept
    once; those behind the watermark are dropped."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "dedupe")
    _replay(_deliveries(spark, base), run, _appending(run, lambda s: cs.dedupe_deliveries(s, f"{DELAY_MS} milliseconds")))
    return spark.read.parquet(f"{run}/out").select("id", "event", "event_timestamp", "source_table")


@register(
    "stream_late_rows",
    f"""
    SELECT source_table, event, epoch_ms(event_timestamp) // 86400000 AS day, make_timestamp(mark * 1000) AS watermark, count(*) AS late_rows
    FROM {_MARKED} WHERE epoch_us(event_timestamp) <= mark * 1000 GROUP BY ALL""",
)
def q_stream_late_rows(spark, sf_dir):
    """B13/B14 side output: the rows behind the watermark of the micro-batch that
    delivered them, counted by table, kind and day."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "late")
    gate = cs.LateGate(f"{run}/gate", delay_ms=DELAY_MS)
    _replay(_deliveries(spark, base), run, lambda s: s.writeStream.foreachBatch(gate).option("checkpointLocation", f"{run}/ckpt").trigger(availableNow=True).start())
    late = gate.read(spark, True)
    day = F.floor(F.unix_millis("event_timestamp") / 86_400_000).alias("day")
    return late.groupBy("source_table", "event", day, "watermark").agg(F.count(F.lit(1)).alias("late_rows"))


@register("stream_dead_letters", "SELECT reason, source_table, row_id FROM dead_letters")
def q_stream_dead_letters(spark, sf_dir):
    """A4: the dead-letter sink's JSON lines, read back."""
    base = _ingest(spark, sf_dir)
    run = _fresh(base, "dead-letters")
    failed = _routed_stream(spark, base).where(F.col("route") == "dlq")
    cs.dead_letter_sink(failed, f"{run}/out", f"{run}/ckpt").awaitTermination()
    read = spark.read.schema("reason string, raw string").json(f"{run}/out")
    m = F.try_parse_json("raw")
    return read.select(
        "reason",
        F.try_variant_get(m, "$.payload.source.table", "string").alias("source_table"),
        F.try_variant_get(m, "$.payload.after.id", "string").alias("row_id"),
    )


@register("stream_watchlist", f"SELECT * FROM {W_STATE}")
def q_stream_watchlist(spark, sf_dir):
    """Watchlist state over the command stream (update-mode streaming
    aggregation; the pandas stateful variant is ``watchlist_updates``)."""
    base = cs.scratch(spark, "watch")
    ticker.watch_commands(load(spark, sf_dir, "events")).repartition(16).write.parquet(f"{base}/in")
    cmds = (
        spark.readStream.schema("seq long, client_id long, repo string, op string")
        .option("maxFilesPerTrigger", "6")
        .parquet(f"{base}/in")
    )
    q = (
        wl.watchlist_changes(cmds)
        .writeStream.outputMode("update")
        .foreachBatch(wl.append_batches(f"{base}/updates"))
        .option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return wl.current_state(spark.read.parquet(f"{base}/updates"))


@register(
    "stream_sessions",
    f"""
    SELECT user_id AS session_key, min(ts) AS session_start, max(ts) + INTERVAL 24 HOUR AS expires_at,
           count(*) AS writes
    FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
                        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
          FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
                FROM events WHERE event_id % 25 <> 3 OR ts >= TIMESTAMP '2024-01-16'))
    GROUP BY user_id, sid
    HAVING epoch_ms(max(ts)) + 86400000 <= (SELECT max(epoch_ms(ts)) - {DELAY_MS} FROM events)""",
)
def q_stream_sessions(spark, sf_dir):
    """H7 streaming: 24 h sliding-expiry sessions per user, emitted once when the
    watermark passes their expiry. Every 25th event of the first two slices comes two
    slices later, behind the watermark, and is in no session."""
    run = cs.scratch(spark, "sessions")
    ev = _slices(load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts")
    held_back = (F.col("event_id") % 25 == 3) & (F.col("slice") < 2)
    sent = ev.select("user_id", "ts", (F.col("slice") + F.when(held_back, 2).otherwise(0)).alias("delivered"))
    _replay(sent, run, _appending(run, lambda s: cs.sessions(s, delay=f"{DELAY_MS} milliseconds")))
    return spark.read.parquet(f"{run}/out")


@register("stream_tick_fanout", TICK_FANOUT_SQL)
def q_stream_tick_fanout(spark, sf_dir):
    """H13 streaming: a stream of ticks joined with the static watch state
    (stream-static inner join), each tick fanned out to its subscribers."""
    from cdcmart.plans.q_misc import _metrics

    base = cs.scratch(spark, "ticks")
    ticker.ticks(_metrics(spark, sf_dir)).repartition(4).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    ticks_stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "2").parquet(f"{base}/in")
    state = ticker.watchlist_state(ticker.watch_commands(load(spark, sf_dir, "events")))
    q = (
        wl.fanout_stream(ticks_stream, state)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/ckpt")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register(
    "stream_live_fanout",
    """
    SELECT t.event_id AS tick_id, t.repo, c.client_id, t.ts AS at, CASE WHEN k = 0 THEN 'error' ELSE 'tick' END AS kind,
           CASE WHEN k <> 0 THEN k END AS price, CASE WHEN k = 0 THEN 'not found: ' || t.repo END AS message
    FROM (SELECT event_id, 'repo-' || user_id AS repo, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
          FROM events WHERE event_type = 'purchase') t
    JOIN (SELECT event_id % 7 AS client_id, 'repo-' || user_id AS repo, ts, event_id % 4 <> 0 AS subscribed,
                 lead(ts) OVER (PARTITION BY event_id % 7, user_id ORDER BY ts) AS until FROM events) c
      ON t.repo = c.repo AND c.ts <= t.ts AND (c.until IS NULL OR c.until > t.ts) AND c.subscribed""",
)
def q_stream_live_fanout(spark, sf_dir):
    """Ticks against watch state that changes between them; both logs are
    delivered in time order, in slices, to one stateful stream."""
    run = cs.scratch(spark, "live")
    ev = _slices(load(spark, sf_dir, "events"), "ts").withColumnRenamed("slice", "delivered")
    at = F.col("ts").cast("timestamp").alias("at")
    commands = ticker.watch_commands(ev).join(ev.select(F.col("event_id").alias("seq"), at, "delivered"), "seq")
    ticks = ticker.live_ticks(ev).join(ev.select(F.col("event_id").alias("tick_id"), "delivered"), "tick_id")
    kinds = {"commands": commands, "ticks": ticks}
    for n in range(len(SLICE_DAYS) + 1):
        streams = {}
        for kind, rows in kinds.items():
            part = rows.where(F.col("delivered") == n).drop("delivered")
            part.write.parquet(f"{run}/{kind}/slice={n}")
            streams[kind] = spark.readStream.schema(part.schema).option("basePath", f"{run}/{kind}").parquet(f"{run}/{kind}")
        _appending(run, lambda _: wl.live_fanout(streams["commands"], streams["ticks"], buckets=2))(None).awaitTermination()
    return spark.read.parquet(f"{run}/out")


@register(
    "stream_progress",
    """
    SELECT b + d + u AS messages, b AS bronze, d AS dlq, u AS undecodable
    FROM (SELECT (SELECT count(*) FROM bronze_keys) AS b, (SELECT count(*) FROM dead_letters) AS d,
                 (SELECT CAST(coalesce(sum(if(event_id % 59 = 7, 2, 1)), 0) AS BIGINT) FROM src_pulls WHERE event_id % 103 = 0) AS u)""",
)
def q_stream_progress(spark, sf_dir):
    """The progress counts of the ingest stream's micro-batches, added up."""
    key = _input_key(spark, sf_dir)
    _INGESTED.pop(key, None)
    progress = spark.read.parquet(f"{_ingest(spark, sf_dir)}/progress")
    return progress.agg(*[F.sum(c).alias(c) for c in ("messages", "bronze", "dlq", "undecodable")])

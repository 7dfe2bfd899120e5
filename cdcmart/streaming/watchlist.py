"""Streaming watchlists and tick fan-out.

The watchlist is kept as state per (client, repo) — the last command seen —
with ``applyInPandasWithState``. Keying by the pair keeps every state row
constant-size however many repos a client watches, and the stored sequence
number makes the operator idempotent: a re-delivered or older command never
overrides a newer one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cdcmart.operators import ticker

OUTPUT_SCHEMA = "client_id long, repo string, subscribed boolean, seq long"
STATE_SCHEMA = "seq long, subscribed boolean"


def _apply(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_seq, subscribed = (state.get if state.exists else (-1, False))
    changed = False
    for pdf in batches:
        if pdf.empty:
            continue
        i = pdf["seq"].idxmax()
        seq = int(pdf.at[i, "seq"])
        if seq > last_seq:
            last_seq, subscribed, changed = seq, pdf.at[i, "op"] == "subscribe", True
    if changed:
        state.update((last_seq, bool(subscribed)))
        yield pd.DataFrame(
            {"client_id": [int(key[0])], "repo": [key[1]], "subscribed": [bool(subscribed)], "seq": [last_seq]}
        )


def watchlist_updates(commands: DataFrame) -> DataFrame:
    """H11 on a stream of (seq, client_id, repo, op): one output row per
    (client, repo) whose state changed in the micro-batch (append mode)."""
    return commands.groupBy("client_id", "repo").applyInPandasWithState(
        _apply, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def watchlist_changes(commands: DataFrame) -> DataFrame:
    """H11, JVM-side: the last command per (client, repo) as a streaming
    aggregation (state store, no Python); run in update mode so each
    micro-batch emits only the pairs it changed."""
    return commands.groupBy("client_id", "repo").agg(
        (F.max_by("op", "seq") == "subscribe").alias("subscribed"), F.max("seq").alias("seq")
    )


def append_batches(path: str):
    """foreachBatch writer: one folder per batch id, so a replayed batch
    overwrites its own output (idempotent)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_state(updates: DataFrame) -> DataFrame:
    """Watch pairs from the collected update rows (latest per pair)."""
    last = updates.groupBy("client_id", "repo").agg(F.max_by("subscribed", "seq").alias("_s"))
    return last.where("_s").select("client_id", "repo")


LIVE_SCHEMA = "tick_id long, repo string, client_id long, at timestamp, kind string, price long, message string"


#: Groups of the fan-out's state; each holds the clients of many (repo, bucket).
SLOTS = 1024


def _live(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a slot: the clients of its (repo, bucket) with the number of their last
    command and whether it subscribed, as JSON."""
    held = {(r, b): clients for r, b, clients in json.loads(state.get[0])} if state.exists else {}
    rows = pd.concat([b for b in batches if not b.empty], ignore_index=True)
    rows = rows.sort_values(["at", "is_tick", "seq"], kind="stable", ignore_index=True)
    at, to, changed = [], [], False
    for n, (is_tick, seq, client, op, repo, bucket) in enumerate(
        zip(*(rows[c].tolist() for c in ("is_tick", "seq", "client_id", "op", "repo", "bucket")), strict=True)
    ):
        clients = held.get((repo, bucket))
        if is_tick:
            for c, (_, subscribed) in (clients or {}).items():
                if subscribed:
                    at.append(n)
                    to.append(int(c))
            continue
        if clients is None:
            clients = held[repo, bucket] = {}
        last = clients.get(str(int(client)))
        if last is None or seq > last[0]:
            clients[str(int(client))], changed = [int(seq), op == "subscribe"], True
    if changed:
        state.update((json.dumps([[r, b, clients] for (r, b), clients in held.items()]),))
    if at:
        ticks = rows.iloc[at]
        bad = ticks["error"].notna()
        yield pd.DataFrame({
            "tick_id": ticks["seq"].astype("int64"), "repo": ticks["repo"], "client_id": to, "at": ticks["at"],
            "kind": bad.map({True: "error", False: "tick"}),
            "price": ticks["price"].where(~bad).fillna(0).astype("int64"), "message": ticks["error"].where(bad, ""),
        })


def live_fanout(commands: DataFrame, ticks: DataFrame, buckets: int = 16, slots: int = SLOTS) -> DataFrame:
    """H13 on two streams: every tick to the clients that watch its repo *then*.

    ``commands``: (at, seq, client_id, repo, op); ``ticks``: (at, tick_id, repo, price,
    error). Both are dealt by hash of (repo, bucket of the client); the watch state lives in
    Spark's state store, and within a micro-batch commands and ticks are taken in time
    order (commands first at the same instant), so a subscribe between two ticks shows
    from the second on. A command older than the client's last one changes nothing;
    ticks that were answered are not answered again. A repo's clients are split over
    ``buckets`` states, each of which gets the tick once. States share ``slots`` groups
    by hash, so the Python calls of a micro-batch are that many at most, not one per repo.
    """
    none = F.lit(None)
    slot = F.pmod(F.xxhash64("repo", "bucket"), F.lit(slots)).cast("int")
    c = commands.select(
        "repo", F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int").alias("bucket"), "at", F.lit(False).alias("is_tick"),
        F.col("seq").cast("long").alias("seq"), F.col("client_id").cast("long").alias("client_id"), "op",
        none.cast("long").alias("price"), none.cast("string").alias("error"),
    )
    t = ticks.select(
        "repo", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "at", F.lit(True).alias("is_tick"),
        F.col("tick_id").cast("long").alias("seq"), none.cast("long").alias("client_id"), none.cast("string").alias("op"),
        F.col("price").cast("long").alias("price"), "error",
    )
    made = c.unionByName(t).withColumn("slot", slot).groupBy("slot").applyInPandasWithState(
        _live, LIVE_SCHEMA, "clients string", "append", GroupStateTimeout.NoTimeout
    )
    return made.select(
        "tick_id", "repo", "client_id", "at", "kind", F.when(F.col("kind") == "tick", F.col("price")).alias("price"),
        F.when(F.col("kind") == "error", F.col("message")).alias("message"),
    )


def fanout_stream(ticks_stream: DataFrame, watch_state: DataFrame) -> DataFrame:
    """Stream-static inner join of ticks with the current watch pairs."""
    return ticker.tick_fanout(ticks_stream, watch_state)

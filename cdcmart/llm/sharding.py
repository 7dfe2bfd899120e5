"""Sharding by balanced label propagation.

Rows of equal texts are linked, each with each. Documents start on random shards
of equal size. In each round every linked document looks at its neighbours'
shards; as all members of a group have the same neighbours, these votes are one
histogram per group (at most one count per shard), joined back to the rows, and
no pair is ever listed. Members that are not on the shard with most of their
group ask to move there; every second round only shards with room stand for
choice, so what a full shard cannot take gathers on another one. Moves are
granted under capacity quotas (Ugander and Backstrom, "Balanced label propagation
for partitioning massive graphs", 2013): two shards may swap as many documents as
the smaller of their mutual demands, and beyond that a shard takes what its quota
leaves free; documents without links only fill the quotas at the end. The last
step makes the sizes exact: what exceeds a quota and all documents without links
are dealt by rank into the places left, so the counts differ by one at most.

Only shard sizes and demand matrices (shards times shards) reach the driver. Ranks
are built from counts by hash bucket, so neither a shard nor a group is sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_rank, materialize, release

ROUNDS = 10


def _unit(*cols) -> Column:
    """A uniform number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _granted(demand: dict[tuple[int, int], int], sizes: dict[int, int], quota: list[int]) -> dict[tuple[int, int], float]:
    """The share of each demand ``(from, to)`` that may move."""
    swap = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    rest = {k: n - swap[k] for k, n in demand.items()}
    asked = {j: sum(n for (_, t), n in rest.items() if t == j) for j in range(len(quota))}
    room = {j: max(0, q - sizes.get(j, 0)) for j, q in enumerate(quota)}
    return {(i, j): (swap[i, j] + rest[i, j] * min(1.0, room[j] / asked[j] if asked[j] else 1.0)) / n for (i, j), n in demand.items()}


def balanced_label_propagation(nodes: DataFrame, group: str, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """``(id, shard, slot)`` of every node: ``shard`` from 0, ``slot`` gapless
    from 0 within its shard; the shards' counts are at most one apart.

    ``nodes`` has a unique ``id``, a uniform 64-bit ``key`` and ``group`` (without
    nulls); the nodes of one group are linked with one another. An empty table
    gives an empty result.
    """
    total = nodes.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    linked = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(group).alias("group"))
    start = F.floor(_unit(F.lit(0), "id") * shards).cast("int")
    labels = materialize(nodes.select("id", F.col(group).alias("group")).join(linked, "group").select("id", "group", start.alias("shard")), "labels")
    for turn in range(1, rounds + 1):
        sizes = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}  # one row per shard
        room = [j for j in range(shards) if sizes.get(j, 0) < quota[j]]
        some = turn % 2 == 0 and 0 < len(room) < shards
        # one row per group; equal counts: the same shard for all members
        vote = F.struct("n", _unit(F.lit(turn), "group", "shard").alias("tie"), F.col("shard").alias("to"))
        votes = labels.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("group").agg(
            F.max(F.when(F.col("shard").isin(room), vote) if some else vote).alias("top"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("all")
        )
        here = F.struct(F.try_element_at("all", F.col("shard")).alias("n"), _unit(F.lit(turn), "group", "shard").alias("tie"))
        goes = F.struct("top.n", "top.tie") > here
        asks = labels.join(best, "group").select("id", "group", "shard", F.when(goes, F.col("top.to")).otherwise(F.col("shard")).alias("to"))
        asks = materialize(asks, "asks")
        counted = asks.groupBy("shard", "to").count().collect()  # shards squared at most
        demand = {(r["shard"], r["to"]): r["count"] for r in counted if r["shard"] != r["to"]}
        release(labels)
        if not demand:
            labels = asks.select("id", "group", "shard")
            if some:
                continue
            break
        share = F.create_map(*[F.lit(x) for (i, j), f in _granted(demand, sizes, quota).items() for x in (i * shards + j, float(f))])
        moves = (F.col("to") != F.col("shard")) & (_unit(F.lit(turn), F.lit("moves"), "id") < F.try_element_at(share, F.col("shard") * shards + F.col("to")))
        labels = materialize(asks.select("id", "group", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        release(asks)
    return _exact(nodes, labels.select("id", "shard"), quota)


def _exact(nodes: DataFrame, labels: DataFrame, quota: list[int]) -> DataFrame:
    """Fill every shard to its quota: linked nodes up to the quota by rank, the
    places left by all other nodes in the order of their keys."""
    placed = materialize(nodes.select("id", "key").join(labels, "id", "left").select("id", "key", F.coalesce("shard", F.lit(-1)).alias("shard")), "placed")
    ranked = materialize(hash_rank(placed, ["shard"], "key", ["id"], "rank"), "ranked")
    limit = F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)
    stays = (F.col("shard") >= 0) & (F.col("rank") < F.when(F.col("shard") >= 0, limit))
    kept = {r["shard"]: r["count"] for r in ranked.where(stays).groupBy("shard").count().collect()}  # one row per shard
    free, begin, table = 0, [], []
    for j, q in enumerate(quota):
        begin.append(free)
        table.append((j, free, free + q - kept.get(j, 0), kept.get(j, 0)))
        free += q - kept.get(j, 0)
    rest = hash_rank(ranked.where(~stays).select("id", "key", F.lit(0).alias("g")), ["g"], "key", ["id"], "rank")
    spots = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(k).cast("long").alias("k")) for j, a, b, k in table])
    spot = F.element_at(F.filter(spots, lambda s: (s["a"] <= F.col("rank")) & (F.col("rank") < s["b"])), 1)
    filled = rest.select("id", spot.alias("spot"), "rank").select(
        "id", F.col("spot.j").cast("int").alias("shard"), (F.col("rank") - F.col("spot.a") + F.col("spot.k")).alias("slot")
    )
    return ranked.where(stays).select("id", F.col("shard").cast("int"), F.col("rank").alias("slot")).union(filled)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (UTF-8 bytes of the text and
    one more), ``text_crc32``, ``shard`` and ``slot``. Rows of equal texts are
    linked, so copies gather on one shard as far as the quotas allow.

    Equal texts are told by SHA-256. A null text has no bytes and is linked with
    the empty texts. Null and repeated ids are rows like any other.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    nodes = docs.select(
        F.monotonically_increasing_id().alias("id"), F.col(id_col).alias("doc"), (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("content"),
    )
    nodes = materialize(nodes.withColumn("key", F.xxhash64(F.lit(4), "doc", "text_crc32")), "nodes")
    # rows of one id and text share a key: those of a null id could be many
    nodes = nodes.withColumn("key", F.xxhash64("key", "id"))
    placed = balanced_label_propagation(nodes.select("id", "key", "content"), "content", shards, rounds)
    return nodes.select("id", "doc", "size", "text_crc32").join(placed, "id").select(
        F.col("doc").alias(id_col), "size", "text_crc32", "shard", "slot"
    )

"""Set-wise upserts and deletes on file tables.

Plain parquet has no MERGE/DELETE, so each operation is an anti-join plus a
union that is written as a new version of the table. All joins are on the
table key; both sides are hash-partitioned on it, and changes are reduced
to one row per key before the join, so the join never fans out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.operators.silver import latest_per_key
from cdcmart.schemas import MAX_CONSTELLATION


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not in ``gone``; a null in a key equals a null."""
    named = gone.select(*[F.col(k).alias(f"_gone{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_gone{i}")) for i, k in enumerate(keys)]
    return rows.join(named, reduce(and_, same), "left_anti")


def merge_upserts(target: DataFrame, changes: DataFrame, keys, order=None) -> DataFrame:
    """Update every column on key match, insert otherwise.

    ``changes`` must have the target's columns. When ``order`` (column names,
    latest = greatest) is given, changes are first reduced to the latest row
    per key; extra order columns are dropped from the result.
    """
    keys = list(keys)
    if order is not None:
        changes = latest_per_key(changes, keys, order)
    changes = changes.select(*target.columns)
    return _without(target, changes, keys).unionByName(changes)


def apply_deletes(target: DataFrame, log: DataFrame, keys, order_free: bool = False) -> DataFrame:
    """Remove keys deleted in a Bronze-shaped change log.

    Keys are read from the log's ``data`` JSON. By default a key is removed
    only when its latest event is a delete (a later re-insert wins);
    ``order_free=True`` removes any key that ever had a delete.
    """
    keys = list(keys)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    j = F.from_json("data", schema)
    k = log.select(*[j[c].alias(c) for c in keys], "event", "ingested_at", "event_timestamp")
    if order_free:
        dels = k.where(F.col("event") == "delete").select(*keys).distinct()
    else:
        last = F.max_by(F.col("event"), F.struct("ingested_at", "event_timestamp", "event"))
        dels = k.groupBy(*keys).agg(last.alias("_last")).where(F.col("_last") == "delete").select(*keys)
    return _without(target, dels, keys)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys, order=None) -> DataFrame:
    """Insert rows whose key is new; on conflict do nothing.

    Within ``rows`` the first per key (by ``order``) wins, as sequential
    inserts would.
    """
    keys = list(keys)
    if order is not None:
        first = F.min_by(F.struct(*[F.col(c) for c in target.columns]), F.struct(*[F.col(c) for c in order]))
        rows = rows.groupBy(*keys).agg(first.alias("_r")).select("_r.*")
    else:
        rows = rows.dropDuplicates(keys)
    new = _without(rows.select(*target.columns), target, keys)
    return target.unionByName(new)


def upsert_overwrite(target: DataFrame, rows: DataFrame, keys, now: Column | None = None, order=None) -> DataFrame:
    """Overwrite on conflict, stamping ``updated_at`` with ``now``."""
    stamp = now if now is not None else F.current_timestamp()
    rows = rows.withColumn("updated_at", stamp)
    return merge_upserts(target, rows, keys, order)


def upsert_increment(
    inventory: DataFrame,
    entries: DataFrame,
    keys=("player_id", "character_id"),
    value: str = "constellation",
    seq: str = "seq",
    cap: int = MAX_CONSTELLATION,
    time: str | None = None,
) -> DataFrame:
    """Capped increment upsert, applied for a whole batch at once.

    Per key, n entries arrive. Existing row: least(old + n, cap) (the
    incoming value is ignored). New row: the first entry's value, then +1
    per further entry, capped: n == 1 -> incoming, else least(incoming + n - 1, cap). ``time`` names the
    entries' time: ``obtained_at`` is that of the inventory, or of a new key's
    first entry, ``updated_at`` that of the last entry.
    """
    keys = list(keys)
    stamps = [] if time is None else [F.min(time).alias("_from"), F.max(time).alias("_to")]
    g = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.col(value), F.col(seq)).alias("_first"), *stamps
    )
    inv = inventory.select(*keys, F.col(value).alias("_old"), *([] if time is None else ["obtained_at", "updated_at"]))
    j = inv.join(g, keys, "full_outer")
    n = F.coalesce(F.col("_n"), F.lit(0))
    new_val = (
        F.when(F.col("_old").isNotNull() & (n == 0), F.col("_old"))
        .when(F.col("_old").isNotNull(), F.least(F.col("_old") + n, F.lit(cap)))
        .when(n == 1, F.col("_first"))
        .otherwise(F.least(F.col("_first") + n - 1, F.lit(cap)))
    )
    out = [*keys, new_val.cast("int").alias(value)]
    if time is not None:
        out += [F.coalesce("obtained_at", "_from").alias("obtained_at"), F.coalesce("_to", "updated_at").alias("updated_at")]
    return j.select(*out)

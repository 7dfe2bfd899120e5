"""Skew-safe running aggregates per group ("segmented scans").

A window ``PARTITION BY key ORDER BY t`` puts every row of a key into one
task; when one key holds a third of the data that task is the job. Here the
rows are range-partitioned on (key, order) instead, so a hot key is split
across many partitions in order, and each scan is computed in two levels:

1. inside each range partition, per key chunk (a window over the chunk,
   bounded by the partition size);
2. a carry per chunk from the same key's chunks in earlier partitions.

Only chunks at partition boundaries can have a carry (a key that continues
from an earlier partition is the first key of its partition), so the carry
table has at most two rows per partition; it is broadcast up to
:data:`BROADCAST_PARTITIONS` partitions and joined by shuffle beyond.

Supported kinds (frame = all earlier rows, plus the current one when
``inclusive``): ``count``, ``sum``, ``max``, ``last`` (last non-null value)
and ``lastpos`` (1-based position within the key of the last row in the
frame where the boolean value is true).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.session import range_partitions

BROADCAST_PARTITIONS = 50_000

KINDS = ("count", "sum", "max", "last", "lastpos")


def _same(cols: Sequence[str]) -> Column:
    """Null-safe equality of the columns of sides ``l`` and ``r``: rows without
    a key are a group like any other."""
    return reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols])


def _agg(kind: str, v: Column) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "sum":
        return F.sum(v)
    if kind == "max":
        return F.max(v)
    return F.last(v, ignorenulls=True)


def segmented_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple],
    partitions: int | None = None,
) -> DataFrame:
    """Add one column per spec: ``name -> (kind, value_column, inclusive)``.

    Results equal ``agg(value) OVER (PARTITION BY keys ORDER BY order ROWS
    BETWEEN UNBOUNDED PRECEDING AND {CURRENT ROW | 1 PRECEDING})``, with
    ``count`` of an empty frame = 0 (``sum``/``max``/``last`` give null).
    ``order`` (names or sort Columns, e.g. ``F.desc(c)``) must make rows
    unique within a key. The ranged rows are checkpointed with every input
    column, so callers select the columns they need first.
    """
    n = partitions or range_partitions(df)
    # tables of at most two rows per range partition: broadcast while that is little
    small = F.broadcast if n <= BROADCAST_PARTITIONS else (lambda t: t)
    names = list(specs)
    base = df
    for name in names:
        kind, val, _ = specs[name]
        if kind not in KINDS:
            raise ValueError(f"unknown scan kind {kind!r}")
        base = base.withColumn(f"_scv_{name}", val if val is not None else F.lit(1))
    # Range bounds come from sampling, and row ids from the partition layout,
    # so the ranged rows are checkpointed (to spark.checkpoint.dir): every
    # later branch must see the same partition ids and row ids.
    ranged = (
        base.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    # 1. chunk-local scans and chunk totals (a chunk = one key inside one partition).
    chunk = Window.partitionBy("_pid", *keys)
    ordered = chunk.orderBy("_mid")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = ranged.withColumn("_sc_lpos", F.row_number().over(ordered)).withColumn("_sc_rows", F.count(F.lit(1)).over(whole))
    for name in names:
        kind, _, inclusive = specs[name]
        frame = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        v = F.col(f"_scv_{name}")
        if kind == "lastpos":
            v = F.when(v, F.col("_sc_lpos"))
        k = "last" if kind == "lastpos" else kind
        local = local.withColumn(f"_scl_{name}", _agg(k, v).over(frame))
        local = local.withColumn(f"_sct_{name}", _agg(k, v).over(whole))
    # 2. boundary chunks: the first and last key of every partition (<= 2 per partition).
    key_struct = F.struct(*[F.col(k) for k in keys])
    bounds = ranged.groupBy("_pid").agg(F.min(key_struct).alias("lo"), F.max(key_struct).alias("hi"))
    bkeys = bounds.select("_pid", F.explode(F.array("lo", "hi")).alias("_k")).select("_pid", "_k.*").distinct()
    summary = (
        local.alias("l")
        .join(small(bkeys).alias("r"), _same(["_pid", *keys]), "left_semi")
        .groupBy(*keys, "_pid")
        .agg(F.first("_sc_rows").alias("_sc_rows"), *[F.first(f"_sct_{name}").alias(f"_sct_{name}") for name in names])
    )
    prev = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # rows of the key in earlier partitions = offset of this chunk's positions
    carry = summary.withColumn("_sc_off", F.coalesce(F.sum("_sc_rows").over(prev), F.lit(0)))
    for name in names:
        kind = specs[name][0]
        t = F.col(f"_sct_{name}")
        if kind == "lastpos":
            c = F.max(F.col("_sc_off") + t).over(prev)  # positions made global, then the latest
        elif kind in ("count", "sum"):
            c = F.sum(t).over(prev)
        else:
            c = _agg(kind, t).over(prev)
        carry = carry.withColumn(f"_scc_{name}", c)
    carry = carry.select(*keys, "_pid", "_sc_off", *[f"_scc_{name}" for name in names])
    out = local.alias("l").join(small(carry).alias("r"), _same([*keys, "_pid"]), "left")
    out = out.select("l.*", "r._sc_off", *[f"r._scc_{name}" for name in names])
    for name in names:
        kind = specs[name][0]
        loc, car = F.col(f"_scl_{name}"), F.col(f"_scc_{name}")
        if kind == "count":
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        elif kind == "sum":
            val = F.when(loc.isNull() & car.isNull(), F.lit(None)).otherwise(
                F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
            )
        elif kind == "max":
            val = F.greatest(loc, car)
        elif kind == "lastpos":
            val = F.when(loc.isNotNull(), loc + F.coalesce(F.col("_sc_off"), F.lit(0))).otherwise(car)
        else:
            val = F.coalesce(loc, car)
        out = out.withColumn(name, val)
    drop = ["_pid", "_mid", "_sc_lpos", "_sc_rows", "_sc_off"] + [
        f"_sc{p}_{name}" for name in names for p in ("v", "l", "t", "c")
    ]
    return out.drop(*drop)

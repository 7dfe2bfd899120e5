"""Connected components with DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
components in MapReduce and beyond", 2014). Each round is a grouped minimum
(combined before the shuffle) and an inner join that adaptive execution can
split, so a hub with a third of all links stays spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        sym.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another one;
    ``component`` is the smallest node reachable.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Edges with a
    null end and loops are ignored; repeated edges count once. No edges give
    an empty result. Each round is written to the shared folder, so the
    lineage stays short and a lost executor costs at most one round.
    """
    current = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        following = materialize(_small_star(_large_star(current)), "cc")
        mark = _mark(following)
        release(current)
        current = following
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hashes of an edge set (three numbers)."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.bit_xor(F.xxhash64("b", F.lit(7), "a")).alias("y"),
    ).first()
    return (row["n"], row["x"], row["y"])

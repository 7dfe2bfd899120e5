"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a pseudo-random order, form blocks of a fixed
number of rows. With integer weights ``a`` out of a total ``A``, block ``i``
(from 0) of a source is released at slot ``floor(i * A / a)`` and due at slot
``ceil((i + 1) * A / a)``; one block runs per slot, and of the released blocks
the one with the earliest deadline goes first. Unit jobs with whole release
times and deadlines on one processor are always schedulable by that rule (Baruah
et al., "Proportionate progress", 1996), so after any number of slots a source
has had less than one block more or less than its share.

When a source runs out of blocks, the weights of the remaining sources hold among
themselves from there on: the share that a source has had by virtual time ``v`` is
the lesser of ``a * v`` and its blocks, the slot is the sum over all sources, and
releases and deadlines are those of the moments at which a share reaches whole
blocks. The same bound holds against these shares. Nothing is dropped or repeated.

At whole ``v`` every source has had a whole number of blocks, so each turn from
``v`` to ``v + 1`` is scheduled on its own, and all turns in which the same sources
are left and none runs out have one order. Plain turns are hence stated once, with
arithmetic from a block's number to its slot; the plan has at most one entry per
block, mostly far less, and depends on the weights and the sources' block counts
alone, one small row per source. Sorting blocks by deadline would need no plan, but
does not keep the bound: releases are what holds the heavy sources back.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_rank

BLOCK_ROWS = 64
STRETCH = 64
BROADCAST_ENTRIES = 1 << 20


def turn_order(own: Mapping[str, tuple[int, int]]) -> list[str]:
    """The source of each slot of one turn: earliest deadline first among released
    blocks; equal deadlines by name. ``own``: weight and blocks of each source in
    this turn, which are fewer where the source runs out."""
    ends, done, gone = [Fraction(0)], [0], [0]
    for at, n, a in sorted((Fraction(n, a), n, a) for a, n in own.values() if n < a):
        if at != ends[-1]:
            ends.append(at)
            done.append(done[-1])
            gone.append(gone[-1])
        done[-1] += n
        gone[-1] += a
    total = sum(a for a, _ in own.values())
    windows: dict[tuple[int, int], tuple[int, int]] = {}

    def window(a: int, i: int) -> tuple[int, int]:
        if (a, i) not in windows:
            low, high = bisect_right(ends, Fraction(i, a)) - 1, bisect_right(ends, Fraction(i + 1, a)) - 1
            release, due = done[low] * a + (total - gone[low]) * i, done[high] * a + (total - gone[high]) * (i + 1)
            windows[a, i] = release // a, -(-due // a)
        return windows[a, i]

    jobs = sorted((*window(a, i), s) for s, (a, n) in own.items() for i in range(n))
    ready: list[tuple[int, str]] = []
    order, at = [], 0
    for slot in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        order.append(heapq.heappop(ready)[1])
    return order


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of a turn in which no source runs out."""
    return turn_order({s: (a, a) for s, a in weights.items()})


def plan(weights: Mapping[str, int], rows: Mapping[str, int], block_rows: int) -> Iterator[tuple]:
    """Runs of blocks that arithmetic takes to their places: ``source``, ``first``
    and ``stop`` (blocks), ``weight`` (blocks of each turn), ``slot``, ``length``
    and ``row``, ``rows`` (start of the run, slots and rows of each turn), and for
    the blocks of a turn ``places`` and ``offsets`` (slots and rows before them)."""
    blocks = {s: -(-n // block_rows) for s, n in rows.items() if n}
    last = {s: (n - 1) // weights[s] for s, n in blocks.items()}
    active, slot, row = sorted(blocks), 0, 0
    cuts = sorted({0, *last.values(), *(k + 1 for k in last.values())})
    for k, following in zip(cuts, cuts[1:], strict=False):
        active = [s for s in active if last[s] >= k]
        order = turn_order({s: (weights[s], min(weights[s], blocks[s] - weights[s] * k)) for s in active})
        found: dict[str, tuple[list[int], list[int]]] = {s: ([], []) for s in active}
        offset = 0
        for place, s in enumerate(order):
            found[s][0].append(place)
            found[s][1].append(offset)
            block = k * weights[s] + len(found[s][0])
            offset += block_rows if block < blocks[s] else rows[s] - (block - 1) * block_rows
        for s, (places, offsets) in found.items():
            a = weights[s]
            if a <= STRETCH:
                yield s, k * a, min(following * a, blocks[s]), a, slot, len(order), row, offset, places, offsets
                continue
            for turn in range(following - k):
                for i in range(0, len(places), STRETCH):
                    part = places[i : i + STRETCH]
                    first = (k + turn) * a + i
                    yield s, first, first + len(part), len(part), slot + turn * len(order), 0, row + turn * offset, 0, part, offsets[i : i + STRETCH]
        slot += (following - k) * len(order)
        row += (following - k) * offset


def whole_weights(shares: Mapping[str, float]) -> dict[str, int]:
    """The least positive integers in exactly the ratio of ``shares``, which are
    taken as the decimal numbers they print as."""
    exact = {s: Fraction(str(x)) for s, x in shares.items()}
    if any(x <= 0 for x in exact.values()):
        raise ValueError("shares must be positive")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    made = {s: int(x * scale) for s, x in exact.items()}
    divisor = math.gcd(*made.values()) if made else 1
    return {s: x // divisor for s, x in made.items()}


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, default: float = 1.0,
) -> DataFrame:
    """All rows of ``docs`` with ``mix_source`` (the source scheduled), ``block``
    (its number within the source), ``slot`` (place of the block in the schedule)
    and ``position`` (gapless from 0).

    ``weights`` gives a share to each source by name, ``default`` to any other;
    no weights: equal shares. A null source counts as the source of the empty
    name. Every source is a class of its own, however many there are. Within a
    source rows follow the hash of their id, then the id; rows of null or repeated
    ids follow each other in any order. Columns of the input under the names of the
    new ones are replaced. An empty table gives an empty result.
    """
    spark, weights = docs.sparkSession, dict(weights or {})
    new = ("mix_source", "block", "slot", "position")
    keep = [c for c in docs.columns if c not in new]
    name = F.coalesce(docs[f"`{source_col}`"].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), name.alias("mix_source"),
        F.xxhash64(F.lit(5), docs[f"`{id_col}`"]).alias("key"), docs[f"`{id_col}`"].alias("id"),
    )
    counts = rows.groupBy("mix_source").count().toArrow()  # one row per source
    n_rows = dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True))
    table = list(plan(whole_weights({s: weights.get(s, default) for s in n_rows}), n_rows, block_rows))
    runs = spark.createDataFrame(
        table, "mix_source string, first long, stop long, weight long, slot0 long, length long, row0 long, rows long, places array<long>, offsets array<long>"
    )
    # a block finds its run by source and stretch: no row meets more than a stretch of runs
    stretch = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("stop") - 1) / STRETCH)))
    runs = runs.select("*", stretch.alias("stretch"))
    if sum(len(t[8]) * ((t[2] - t[1]) // STRETCH + 2) for t in table) <= BROADCAST_ENTRIES:
        runs = F.broadcast(runs)
    local = F.col("block") - F.col("first")
    turn, at = F.floor(local / F.col("weight")), (local % F.col("weight")).cast("int")
    slot = F.col("slot0") + turn * F.col("length") + F.get("places", at)
    position = F.col("row0") + turn * F.col("rows") + F.get("offsets", at) + F.col("rank") % block_rows
    ranked = hash_rank(rows, ["mix_source"], "key", ["id"], "rank").withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    return (
        ranked.withColumn("stretch", F.floor(F.col("block") / STRETCH))
        .join(runs, ["mix_source", "stretch"])
        .where("block >= first and block < stop")
        .select(
            *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "mix_source", "block", slot.cast("long").alias("slot"), position.cast("long").alias("position")
        )
    )


def mixed_rows(
    docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", **options
) -> DataFrame:
    """``docs``, all rows and columns, range-sorted into mixing order."""
    whole = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"),
        docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("source"),
    )
    made = mix(whole, weights, "id", "source", **options).orderBy("position")
    return made.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])

"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared exactly, with numpy exclusive-or and bit counts, in
tiles. The tiles come from a partition that loses no pair: the 64 bits are cut
into ``radius + 1`` bands, and two fingerprints within the radius agree on one
band at least. Distinct fingerprints are dealt by (band, leading bits of that
band); the number of leading bits follows the number of fingerprints, so an
average group is about one tile and the work per fingerprint stays level. A
group of more than one tile is sorted by bit count and cut into tiles; tile
pairs whose bit counts differ by more than the radius are skipped, the others
are compared in tasks of their own.

A tile pair emits only a spanning forest of its links (at most as many edges as
fingerprints), which gives the same components as all its pairs would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, text_of, to_arrow
from .components import connected_components

BITS = 64
TILE = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 16
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text``, repeats included.

    A-Z are lower-cased; words are runs of characters other than space and
    0x09 to 0x0D. Fewer words than a shingle: the whole sequence is the only
    one; no word: zero. Shingles are hashed in blocks, so a very long text
    takes a bounded amount of memory besides itself.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        stop = min(n, at + _BLOCK)
        own = parts[at : stop + words - 1]
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        begins = np.concatenate([[0], ends[:-1]])
        width = min(words, len(parts))
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins[: stop - at].tolist(), (ends[width - 1 :] - 1).tolist(), strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((np.uint64(1) << _SHIFTS)[2 * counts > n].sum(dtype=np.uint64))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, carry: bool = False
) -> DataFrame:
    """``(id, row, fp, own)`` of every row; ``fp`` as a signed 64-bit integer,
    ``own`` the input row with ``carry``, else null."""
    own = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"), own.alias("own"))
    schema = T.StructType([rows.schema["id"], rows.schema["row"], T.StructField("fp", T.LongType()), rows.schema["own"]])
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(values.view(np.int64)), batch.column("own")], schema=target)

    return rows.mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links within a tile, or between two tiles."""
    own = a if b is None else np.concatenate([a, b])
    parent = list(range(len(own)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    other, shift = (a, 0) if b is None else (b, len(a))
    rows = max(1, (1 << 22) // max(1, len(other)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ other[None, :]) <= radius
        x, y = np.nonzero(near)
        for i, j in zip((x + at).tolist(), (y + shift).tolist(), strict=True):
            if i < j and (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
                yield int(own[i]), int(own[j])


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that join distinct fingerprints ``fp`` at ``radius`` or
    fewer differing bits into the same components as all such pairs."""
    n = distinct.count()
    bands = radius + 1
    width = BITS // bands
    lead = max(0, min(width, math.ceil(math.log2(max(1, n / tile)))))
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    dealt = distinct.select("fp", band.alias("band")).select(
        "fp", "band", F.expr(f"shiftrightunsigned(shiftleft(fp, band * {width}), {BITS - lead})" if lead else "0L").alias("key"), F.bit_count("fp").alias("ones")
    )
    # place in the group by bit count, from small counts (a group has 65 bit counts)
    sizes = dealt.groupBy("band", "key", "ones").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("band", "key").orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)
    layout = sizes.select("band", "key", "ones", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    # the tiles of one bit count: the ones its run of places overlaps, spread by hash
    tiled = dealt.join(layout, ["band", "key", "ones"]).withColumn(
        "tile",
        (F.floor(F.col("before") / tile) + F.when(F.col("n") <= tile, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)))).cast("long"),
    )
    spans = tiled.groupBy("band", "key", "tile").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"))
    first, second = spans.alias("s"), spans.alias("o")
    pairs = first.join(
        second,
        F.expr(f"s.band = o.band and s.key = o.key and s.tile <= o.tile and o.lo - s.hi <= {radius} and s.lo - o.hi <= {radius}"),
    ).select(F.col("s.band").alias("band"), F.col("s.key").alias("key"), F.col("s.tile").alias("t1"), F.col("o.tile").alias("t2"))
    parts = pairs.select("band", "key", "t1", "t2", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("tile"))
    members = parts.join(tiled.select("band", "key", "tile", "fp"), ["band", "key", "tile"]).select(
        "band", "key", "t1", "t2", (F.col("tile") == F.col("t1")).alias("left"), "fp"
    )

    def compare(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = fps[left], None if left.all() else fps[~left]
        edges = np.array(list(_forest(a, b, radius)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return members.groupBy("band", "key", "t1", "t2").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """One row per input row: ``id_col``, ``row`` (a number of the row in this
    run), ``fp`` (signed 64-bit integer), ``component_id`` (smallest id reachable
    over links of ``radius`` or fewer differing bits, itself included) and
    ``first`` (whether the row is its component's first: smallest id, null ids
    last, then the smallest row number).

    Null texts count as empty; texts without words have fingerprint zero and
    link like any other. Rows that repeat an id belong to the component of
    their own text. A component of null ids only has a null ``component_id``.
    An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words, seed).drop("own"), "prints")
    return prints.join(_classes(prints, radius, tile), "fp").select(
        F.col("id").alias(id_col), "row", "fp", F.col("head.id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("first")
    )


def first_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """The first row of each component (see :func:`near_duplicates`) with all
    its columns, in the input's column order."""
    prints = materialize(fingerprints(docs, id_col, text_col, words, seed, carry=True), "prints")
    kept = prints.join(_classes(prints, radius, tile).select("fp", F.col("head.row").alias("row")), ["fp", "row"])
    return kept.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _classes(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """``(fp, head)`` of every distinct fingerprint; ``head`` is the first row
    of its component."""
    # equal fingerprints fold to one row before anything is shuffled
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    distinct = materialize(prints.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), radius, tile))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    heads = joined.groupBy("component").agg(F.min("least").alias("head"))
    classes = materialize(joined.join(heads, "component").select("fp", "head"), "classes")
    release(distinct)
    return classes

"""Product codes of integer vectors through per-dimension value dictionaries.

A component x counts as the integer floor(256 x). Vectors are cut into equal
consecutive parts; each part position has a codebook. Inside a task the rows of a
block are dictionary-encoded per dimension (``np.unique``): the squared difference
of every *distinct* integer to every entry of the codebook is tabulated once, and
the distances of a part are gathers of table rows by dictionary code, added over
the part's dimensions. All arithmetic is 64-bit integer.

Codebooks (parts x entries, a few thousand integers, whatever the input) go to
the tasks with the job; each round a task sends back one partial sum per part and
entry, which Spark adds up before the driver sees one row per part and entry.

Defined results: rows whose vector is null, empty, or has a null, non-finite or
larger component than :data:`LARGEST` in size are dropped; of the rest only
vectors of the most frequent length (the greater, on a tie) are kept, and a length
that the number of parts does not divide is filled up with zeros. Repeated
``vec_id`` values stay separate rows; null ids come last when the first entries are
chosen, and rows of one id are ordered by their vector. Fewer rows than entries
give shorter codebooks; no rows give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, to_arrow

SCALE = 256
#: Components beyond this size would leave 64-bit sums of squares.
LARGEST = float(1 << 18)
#: Label sums of up to this many labels are broadcast (about 20 MB); more are joined by shuffle.
BROADCAST_LABELS = 500_000
SALTS = 64
#: Distances held at once inside a task: rows of a block times entries.
BLOCK_CELLS = 1 << 19


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers of shape (parts, entries, width); ``cells``: distances that
    a task holds at once."""

    length: int
    entries: np.ndarray
    cells: int = BLOCK_CELLS

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(vectors: DataFrame) -> DataFrame:
    """The kept rows with their vector as integers (``vec_id``, ``label``, ``v``)."""
    x = F.col("embedding").cast("array<double>")
    usable = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > LARGEST))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & usable)
    return kept.select("vec_id", "label", F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def _first_entries(rows: DataFrame, parts: int, entries: int, cells: int) -> Codebooks | None:
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return None
    length = lengths[0]["n"]
    chosen = rows.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = -(-length // parts)
    first = np.zeros((len(chosen), parts * width), np.int64)
    for i, row in enumerate(chosen):
        first[i, :length] = row["v"]
    return Codebooks(length, np.ascontiguousarray(first.reshape(len(chosen), parts, width).transpose(1, 0, 2)), cells)


def _blocks(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers of shape (rows, parts, width)) of an Arrow batch."""
    parts, entries, width = books.entries.shape
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, books.length)
    step = max(1, books.cells // entries)
    for at in range(0, len(flat), step):
        block = np.zeros((min(step, len(flat) - at), parts * width), np.int64)
        block[:, : books.length] = flat[at : at + step]
        yield at, block.reshape(-1, parts, width)


def nearest(block: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of every row (ties: lower entry)."""
    parts, entries, width = books.entries.shape
    code = np.empty((len(block), parts), np.int64)
    error = np.empty((len(block), parts), np.int64)
    reach = max(block.max(initial=0), books.entries.max(initial=0)) - min(block.min(initial=0), books.entries.min(initial=0))
    kind = np.int32 if width * int(reach) ** 2 < 1 << 31 else np.int64  # no sum of squares exceeds it
    for p in range(parts):
        distance = np.zeros((len(block), entries), kind)
        for j in range(width):
            values, place = np.unique(block[:, p, j], return_inverse=True)  # the dimension's dictionary
            table = ((values[:, None] - books.entries[p, None, :, j]) ** 2).astype(kind)
            distance += table.take(place, axis=0)
        code[:, p] = distance.argmin(axis=1)
        error[:, p] = np.take_along_axis(distance, code[:, p, None], axis=1)[:, 0]
    return code, error


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Number and componentwise sum of the parts of every entry."""
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("place", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("total", T.LongType()),
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, block in _blocks(batch, books):
                code, _ = nearest(block, books)
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(total[p], code[:, p], block[:, p])
        part, entry, place = (a.reshape(-1) for a in np.indices(total.shape))
        made = [part, entry, place, np.repeat(n.reshape(-1), width), total.reshape(-1)]
        used = made[3] > 0
        arrays = [pa.array(a[used], type=f.type) for a, f in zip(made, to_arrow(schema), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=to_arrow(schema))

    return rows.select("v").mapInArrow(partial, schema).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, cells: int = BLOCK_CELLS) -> Codebooks | None:
    """Codebooks of integer vectors (:func:`integers`): the first are the parts of
    the rows of the smallest ids; each round assigns every part to its nearest
    entry and moves every used entry to the floor of its parts' mean. None without
    rows."""
    books = _first_entries(rows, parts, entries, cells)
    for _ in range(rounds if books else 0):
        moved = books.entries.copy()
        for r in _sums(rows.where(F.size("v") == books.length), books).collect():  # parts x entries x width rows
            moved[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        books = replace(books, entries=moved)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (one byte per part) and ``error`` (squared
    distance to the entries, added over the parts) of every row."""
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in _blocks(batch, books):
                code, error = nearest(block, books)
                part = batch.slice(at, len(block))
                columns = [part.column("vec_id"), part.column("label"), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(error.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, schema=to_arrow(schema))

    return rows.where(F.size("v") == books.length).mapInArrow(assign, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The integer vector that each ``code`` stands for (column ``v``)."""
    parts, _, width = books.entries.shape
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books.entries.tolist()])
    at = [F.element_at(F.element_at(table, p + 1), F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int") + 1) for p in range(parts)]
    return codes.withColumn("v", F.slice(F.concat(*at), 1, books.length))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over equal labels (nulls
    are equal). The sums are pre-aggregated; a hot label's rows are salted where
    the sums are too many to broadcast."""
    held = materialize(codes, "codes")
    sums = held.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = materialize(sums, "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        other = F.broadcast(sums.withColumnRenamed("label", "_label"))
        return held.join(other, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = held.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    other = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_of"))
    return salted.join(other, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of"))).drop("_label", "_salt", "_of")


def code_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, cells: int = BLOCK_CELLS) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable rows with label errors, and the final codebooks."""
    if entries > 256:
        raise ValueError("a code has one byte per part")
    rows = integers(vectors)
    books = train(rows, parts, entries, rounds, cells)
    if books is None:
        empty = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
        return empty.where(F.lit(False)), None
    return with_label_error(encode(rows, books)), books

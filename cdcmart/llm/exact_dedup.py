"""Exact dedup by Grace hash partitioning.

Records are partitioned by a hash of their whole text until each bucket fits
an open-addressing table that compares complete texts:

1. *Combine.* Every task folds its own rows in a bounded table and passes on
   one record per distinct text, so a text that fills a third of the corpus
   leaves each task as a handful of records.
2. *Partition.* The records are dealt by hash into buckets of a set size and
   each bucket is resolved in one table. Once a table is full it takes no new
   text; all records of texts that are not in it are written to a spill table
   in the shared folder.
3. *Recurse.* The spill table is dealt again with the next hash seed, until
   nothing is spilled. Every level settles at least one text per bucket.

All intermediate results are Parquet tables in the shared folder or Spark
shuffles, so lost executors are recomputed from them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, materialize, release, shuffle_partitions, text_of, to_arrow

COMBINE_BYTES = 32 << 20
BUCKET_BYTES = 64 << 20


class ContentTable:
    """Open-addressing table from complete text to an entry number."""

    def __init__(self, limit: int) -> None:
        self.limit, self.used = limit, 0
        self.texts: list[str] = []
        self.hashes: list[int] = []
        self.slots = array("q", [-1]) * 1024

    def find(self, h: int, text: str) -> int:
        """The entry of ``text``, or -1."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
            at = (at + 1) & mask
        return -1

    def full(self) -> bool:
        return self.used >= self.limit

    def add(self, h: int, text: str) -> int:
        e = len(self.texts)
        self.texts.append(text)
        self.hashes.append(h)
        self.used += len(text) * 2 + 200
        if 2 * (e + 1) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for i, old in enumerate(self.hashes):
                self._place(old, i)
        else:
            self._place(h, e)
        return e

    def _place(self, h: int, e: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = e


def _later(a: tuple, b: tuple) -> bool:
    """Whether row key ``a = (id, uid)`` wins over ``b``: larger id, null ids
    last, then the larger row number."""
    return (a[0] is not None, a[0] if a[0] is not None else 0, a[1]) > (b[0] is not None, b[0] if b[0] is not None else 0, b[1])


def _combine(schema: pa.Schema, limit: int, members: bool):
    """Task-side fold. ``m`` rows: one per input row; ``r`` rows: one per
    distinct text and table filling."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, count, first, carry = ContentTable(limit), [], [], [], []

        def reps() -> Iterator[pa.RecordBatch]:
            made = (
                (2 * len(table.texts[e]), {"kind": "r", "rep": first[e], "id": best[e][0], "uid": best[e][1], "n": count[e], "h": table.hashes[e], "text": table.texts[e], "row": carry[e]})
                for e in range(len(first))
            )
            return blocks(((n, tuple(r.get(c) for c in names)) for n, r in made), schema)

        for batch in batches:
            if table.full():
                yield from reps()
                table, best, count, first, carry = ContentTable(limit), [], [], [], []
            ids, uids = batch.column("id").to_pylist(), batch.column("uid").to_pylist()
            hashes, texts, rows = batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("row")
            reps_of = []
            for i, (key, h, text) in enumerate(zip(zip(ids, uids, strict=True), hashes, texts, strict=True)):
                e = table.find(h, text)
                if e < 0:
                    e = table.add(h, text)
                    best.append(key)
                    count.append(1)
                    first.append(key[1])
                    carry.append(rows[i].as_py())
                else:
                    count[e] += 1
                    if _later(key, best[e]):
                        best[e] = key
                        carry[e] = rows[i].as_py()
                reps_of.append(first[e])
            if members:
                n = batch.num_rows
                cols = {"kind": pa.array(["m"] * n), "rep": pa.array(reps_of, pa.int64()), "id": batch.column("id"), "uid": batch.column("uid"), "extra": batch.column("extra")}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)
        yield from reps()

    return run


def _resolve(schema: pa.Schema, limit: int, keep_rows: bool):
    """Settle one bucket. ``map``: record -> survivor; ``keep``: a survivor
    with its text and columns; ``spill``: a record of the next level."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, best, count, reps, carry = ContentTable(limit), [], [], [], []

        def spilled() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                cols = {c: batch.column(c).to_pylist() for c in ("rep", "id", "uid", "n", "h", "text")}
                rows = batch.column("row")
                for i in range(batch.num_rows):
                    key, h, text = (cols["id"][i], cols["uid"][i]), cols["h"][i], cols["text"][i]
                    e = table.find(h, text)
                    if e < 0 and table.full() and reps:
                        record = {c: v[i] for c, v in cols.items()} | {"kind": "spill", "row": rows[i].as_py()}
                        yield 2 * len(text), tuple(record.get(c) for c in names)
                        continue
                    if e < 0:
                        e = table.add(h, text)
                        best.append(key)
                        count.append(cols["n"][i])
                        reps.append(array("q", [cols["rep"][i]]))
                        carry.append(rows[i].as_py() if keep_rows else None)
                    else:
                        count[e] += cols["n"][i]
                        reps[e].append(cols["rep"][i])
                        if _later(key, best[e]):
                            best[e] = key
                            if keep_rows:
                                carry[e] = rows[i].as_py()

        def settled() -> Iterator[tuple[int, tuple]]:
            for e, members in enumerate(reps):
                shared = {"id": best[e][0], "uid": best[e][1], "n": count[e]}
                if keep_rows:
                    record = shared | {"kind": "keep", "text": table.texts[e], "row": carry[e]}
                    yield 2 * len(table.texts[e]), tuple(record.get(c) for c in names)
                else:
                    for rep in members:
                        record = shared | {"kind": "map", "rep": rep}
                        yield 0, tuple(record.get(c) for c in names)

        yield from blocks(spilled(), schema)
        yield from blocks(settled(), schema)

    return run


def _records(docs: DataFrame, id_col: str, text_col: str, extra: Sequence[str], carry: Sequence[Column], members: bool, combine_bytes: int) -> DataFrame:
    none = F.lit(None).cast("struct<none:int>")
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        text.alias("text"),
        F.xxhash64(text).alias("h"),
        (F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(extra)]) if extra else none).alias("extra"),
        (F.struct(*[c.alias(f"c{i}") for i, c in enumerate(carry)]) if carry else none).alias("row"),
    )
    schema = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("rep", T.LongType()), rows.schema["id"], rows.schema["uid"]]
        + [T.StructField("n", T.LongType()), rows.schema["h"], rows.schema["text"], rows.schema["extra"], rows.schema["row"]]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return rows.mapInArrow(_combine(to_arrow(schema), combine_bytes, members), schema)


def _settle(records: DataFrame, keep_rows: bool, bucket_bytes: int) -> list[DataFrame]:
    """Resolve the combined records level by level; the settled tables."""
    spark = records.sparkSession
    schema = T.StructType([f for f in records.schema if f.name not in ("extra",)])
    level, done, pending = 0, [], records
    size = records.agg(F.sum(F.length("text") * 2 + 200)).first()[0] or 0
    while True:
        n = max(shuffle_partitions(spark) if level == 0 else 1, -(-size // bucket_bytes))
        dealt = pending.select(*schema.names).repartition(int(n), F.xxhash64(F.lit(level), "h"))
        out = materialize(dealt.mapInArrow(_resolve(to_arrow(schema), bucket_bytes, keep_rows), schema), "grace", ["kind"])
        if level:
            done.append(out)
        else:
            done = [out]
        spill = out.where("kind = 'spill'")
        size = spill.agg(F.sum(F.length("text") * 2 + 200)).first()[0] or 0
        if not size:
            return done
        pending, level = spill, level + 1


def dedup_decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = (),
    combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per input row: ``extra`` columns, ``id_col``, ``keep_id`` (id of
    the row that stays), ``group_size`` and ``kept``.

    Texts are equal when identical; null counts as empty and empty texts are a
    group like any other. Of equal texts the row with the largest id stays;
    null ids lose against any id; of rows that repeat the winning id exactly
    one stays. An empty table gives an empty result. Column names of the input
    cannot clash with inner names, since only the named columns are read and
    ``extra`` columns travel in a struct.
    """
    table = materialize(_records(docs, id_col, text_col, extra, (), True, combine_bytes), "combined", ["kind"])
    settled = _settle(table.where("kind = 'r'").drop("extra"), False, bucket_bytes)
    found = settled[0].where("kind = 'map'")
    for more in settled[1:]:
        found = found.union(more.where("kind = 'map'"))
    found = found.select("rep", F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size"))
    return (
        table.where("kind = 'm'")
        .select("rep", "id", "uid", "extra")
        .join(found, "rep")
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
            *[F.col(f"extra.c{i}").alias(c) for i, c in enumerate(extra)],
        )
    )


def dedup_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The surviving rows with all their columns, in the input's column order.

    Same rules as :func:`dedup_decisions`. A null text that stays is returned
    as null again (only the comparison takes it as empty).
    """
    carry = [c for c in docs.columns if c != text_col]
    columns = [docs[f"`{c}`"] for c in carry] + [docs[text_col].isNull()]
    records = materialize(_records(docs, id_col, text_col, (), columns, False, combine_bytes), "combined")
    settled = _settle(records.drop("extra"), True, bucket_bytes)
    release(records)
    kept = settled[0].where("kind = 'keep'")
    for more in settled[1:]:
        kept = kept.union(more.where("kind = 'keep'"))
    text = F.when(~F.col(f"row.c{len(carry)}"), F.col("text")).cast(docs.schema[text_col].dataType)
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(carry)} | {text_col: text}
    return kept.select(*[place[c].alias(c) for c in docs.columns])

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.session import work_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder (``spark.checkpoint.dir``)."""
    return f"{work_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame | None) -> None:
    """Delete the folder behind a table of :func:`materialize` that no later
    step reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    root = f"{work_dir(spark)}/llm/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        head, found, tail = path.partition("/llm/")
        if found and f"{head}/llm/".split(":", 1)[-1].lstrip("/") == root.split(":", 1)[-1].lstrip("/"):
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}{tail.split('/', 1)[0]}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def blocks(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack ``(bytes, row)`` pairs into record batches of about ``limit`` bytes."""
    held: list[tuple] = []
    size = 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def hash_rank(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], out: str, rows_per_bucket: int = 4_096) -> DataFrame:
    """``df`` with the zero-based rank ``out`` of each row within ``group``
    (columns without nulls) by a uniform 64-bit ``key``; ``ties`` order rows of
    equal keys.

    A group may hold most rows, so it is never sorted in one task: rows fall
    into buckets by the high bits of ``key``; the rank is the count of the
    group's earlier buckets plus the row number inside the bucket. The rows are
    shuffled once, by group and bucket; only counts move besides.
    """
    bits = max(0, math.ceil(math.log2(max(1, df.count() / rows_per_bucket))))
    rows = df.withColumn("_bucket", F.shiftright(F.col(key), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, *ties)
    ranked = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*group, "_bucket"]).select(*[ranked[f"`{c}`"] for c in df.columns], (F.col("_row") + F.col("_before")).cast("long").alias(out))

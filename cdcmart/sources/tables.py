"""Readers for the driver-generated parquet tables."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.session import stored_bytes

DRIVER_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filters reach the reader."""
    return spark.read.parquet(table_path(sf_dir, name))


#: A spread gives a task so many stored bytes at most, and makes no task for less than the second.
SPREAD_BYTES, LEAST_BYTES = 4 << 20, 256 << 10


def spread(df: DataFrame, path: str) -> DataFrame:
    """The rows of the table stored at ``path``, dealt evenly over tasks in number to its
    bytes, and over all cores. A scan has a task per row group at most, so what a few large row
    groups hold would be worked on by a few tasks, each with more than its memory."""
    spark = df.sparkSession
    size = stored_bytes(spark, path)
    n = max(min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), -(-size // SPREAD_BYTES))
    return df.repartition(n) if n > 1 else df


def load_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(load(spark, sf_dir, name), table_path(sf_dir, name))


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the paths, sizes and times of all table files under ``sf_dir``
    (listed, not read): another input under the same path gives another one. A
    listing holds for :data:`LISTED_SECONDS` within an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    listed = _LISTED.get(at)
    if listed is None or time.monotonic() - listed[0] > LISTED_SECONDS:
        listed = _LISTED[at] = (time.monotonic(), _list(spark, sf_dir))
    return listed[1]


#: So many seconds one listing of a folder serves the queries that follow each other.
LISTED_SECONDS = 10.0
_LISTED: dict[tuple[str, str], tuple[float, str]] = {}


def _list(spark: SparkSession, sf_dir: str) -> str:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf_dir)
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    n, mix = files.agg(F.count(F.lit(1)), F.bit_xor(one)).first()
    return f"{n}-{mix}"


def load_all(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in names if os.path.exists(table_path(sf_dir, n))}

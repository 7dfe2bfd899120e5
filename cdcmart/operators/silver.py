"""Silver: parse, type and deduplicate Bronze.

One generic builder driven by the specs in ``cdcmart.schemas``. Latest-per-key is an
aggregate, ``max`` over one struct (ordering columns first, then the payload), instead
of a ``row_number`` window: partial aggregation keeps one row per key per map task
before the shuffle, so a key that holds a third of all rows costs one row per task.
Every column is in that struct once, so the payload is moved once; only the key fields
are read from the JSON text before the aggregate, and the winners alone are parsed
(``from_json`` into an all-string struct, which keeps numbers and booleans as their JSON
text, like a JSON-path extract).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.functions.columns import composite_key, typed
from cdcmart.schemas import SILVER_SPECS, SilverSpec

# Deterministic order for "latest": ingested_at, then the tie-breakers.
DEFAULT_ORDER = ("ingested_at", "event_timestamp", "event", "data")


def keep_upserts(bronze: DataFrame, honor_deletes: bool = False) -> DataFrame:
    """Keep insert/update events.

    The default drops deletes *before* ranking, so a deleted row keeps its
    last upsert. ``honor_deletes`` ranks first (see :func:`build_silver`).
    """
    if honor_deletes:
        return bronze
    return bronze.where(F.col("event").isin("insert", "update"))


def json_fields(spec: SilverSpec) -> T.StructType:
    names = [c for c, _ in spec.columns]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def latest_per_key(df: DataFrame, keys: list[str], order=DEFAULT_ORDER) -> DataFrame:
    """The latest row per key under a total order (descending); rows that
    agree in ``order`` are told apart by their other columns."""
    payload = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in [*order, *payload]])).alias("_best")
    kept = df.groupBy(*keys).agg(best)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def typed_rows(rows: DataFrame, spec: SilverSpec, data: Column | str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """The Silver columns of JSON rows, after the columns ``keep``. The text is parsed in
    a projection of its own: taken apart in the same one, it would be parsed per column."""
    text = F.col(data) if isinstance(data, str) else data
    parsed = rows.select(*keep, F.from_json(text, json_fields(spec)).alias("_j"))
    cols = [composite_key(*[F.col(f"_j.{k}") for k in spec.keys]).alias("id")] if spec.synthetic_id else []
    return parsed.select(*keep, *cols, *[typed(F.col(f"_j.{name}"), kind).alias(name) for name, kind in spec.columns])


def latest_changes(bronze: DataFrame, spec: SilverSpec | str, honor_deletes: bool = False) -> DataFrame:
    """The latest change of every key: the key fields ``_k0``..., then the columns of
    :data:`DEFAULT_ORDER` (``data`` still as JSON)."""
    spec = SILVER_SPECS[spec] if isinstance(spec, str) else spec
    src = keep_upserts(bronze.where(F.col("source_table") == spec.table), honor_deletes)
    schema = T.StructType([T.StructField(k, T.StringType(), True) for k in spec.keys])
    parsed = src.select(F.from_json("data", schema).alias("_j"), *DEFAULT_ORDER)
    keys = [F.col(f"_j.{k}").alias(f"_k{i}") for i, k in enumerate(spec.keys)]
    return latest_per_key(parsed.select(*keys, *DEFAULT_ORDER), [f"_k{i}" for i in range(len(keys))])


def build_silver(bronze: DataFrame, spec: SilverSpec | str, honor_deletes: bool = False) -> DataFrame:
    """The Silver table of ``spec.table`` from the Bronze log."""
    spec = SILVER_SPECS[spec] if isinstance(spec, str) else spec
    latest = latest_changes(bronze, spec, honor_deletes)
    if honor_deletes:
        latest = latest.where(F.col("event") != "delete")
    return typed_rows(latest, spec)


def build_all(bronze: DataFrame, honor_deletes: bool = False) -> dict[str, DataFrame]:
    return {f"stg_{t}": build_silver(bronze, s, honor_deletes) for t, s in SILVER_SPECS.items()}

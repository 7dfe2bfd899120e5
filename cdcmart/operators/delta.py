"""Delta propagation: changes of a table as (key, row, was).

``row`` is a key's new row (null where the key is gone), ``was`` the row it replaces
(null for a new key). A change is a retraction of ``was`` and an addition of ``row``,
so sums and counts of any grouping are patched by signed sums of the changes alone,
and a distinct count by the groups whose number of rows leaves or reaches zero.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(*cols: str) -> Column:
    """One text key of several columns; a null is a value of its own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))


def of_keys(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """The versions of the given keys only, so that what follows moves no more than
    the change touches."""
    return versions.join(keys.select("key").distinct(), "key", "left_semi")


def newest(versions: DataFrame) -> DataFrame:
    """(key, row): the row of every key's last run."""
    return versions.groupBy("key").agg(F.max_by("row", "run").alias("row"))


def accept(candidates: DataFrame, held: DataFrame | None) -> DataFrame:
    """The candidates (key, row) that are later than the held row of their key, with
    the row they replace. Rows are ordered as structs."""
    if held is None:
        row = candidates.schema["row"].dataType
        return candidates.select("key", "row", F.lit(None).cast(row).alias("was"))
    both = candidates.join(held.withColumnRenamed("row", "was"), "key", "left")
    return both.where(F.col("was").isNull() | (F.col("row") > F.col("was"))).select("key", "row", "was")


def pair(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Changes from the new and the old rows of the touched keys; rows that stay the
    same are no change."""
    n = new.select(key_of(*keys).alias("key"), F.struct(*[F.col(c) for c in new.columns]).alias("row"))
    o = old.select(key_of(*keys).alias("key"), F.struct(*[F.col(c) for c in new.columns]).alias("was"))
    return n.join(o, "key", "full_outer").where(~F.col("row").eqNullSafe(F.col("was"))).select("key", "row", "was")


def signed(changes: DataFrame) -> DataFrame:
    """Retractions (``sign`` -1) and additions (1) with the rows' columns."""
    made = F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("row").alias("r")))
    return changes.select(F.explode(made).alias("_c")).where(F.col("_c.r").isNotNull()).select("_c.sign", "_c.r.*")


def patch_sums(held: DataFrame | None, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """New totals (key, row) of the groups that ``delta`` (one row per group, the sums'
    differences) really changes."""
    moved = delta.where(reduce(or_, [F.col(c) != 0 for c in sums]))
    moved = moved.select(key_of(*keys).alias("key"), *keys, *sums)
    if held is None:
        return moved.select("key", F.struct(*keys, *sums).alias("row"))
    both = moved.alias("d").join(held.alias("h"), "key", "left")
    total = [(F.col(f"d.{c}") + F.coalesce(F.col(f"h.row.{c}"), F.lit(0))).alias(c) for c in sums]
    return both.select("key", F.struct(*[F.col(f"d.{k}").alias(k) for k in keys], *total).alias("row"))


def distinct_delta(held: DataFrame | None, counts: DataFrame, group: list[str], out: str) -> DataFrame:
    """Per ``group``, how its number of present members changes: members are the keys
    of ``counts`` (key, row with ``n``; their new counts), ``held`` their counts before."""
    now = counts.select("key", *[F.col(f"row.{g}").alias(g) for g in group], (F.col("row.n") > 0).cast("long").alias("now"))
    if held is None:
        return now.groupBy(*group).agg(F.sum("now").alias(out))
    was = held.select("key", (F.col("row.n") > 0).cast("long").alias("was"))
    both = now.join(was, "key", "left")
    return both.groupBy(*group).agg(F.sum(F.col("now") - F.coalesce("was", F.lit(0))).alias(out))

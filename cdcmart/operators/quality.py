"""Data quality and reconciliation.

Checks are folded: per model, every ``not_null`` and ``accepted_values`` test
is one aggregate pass; each ``unique`` test is one grouped aggregate (with
map-side partial counts); ``relationships`` is a left-anti join. Reconciliation
compares all tables at once, by range digests before keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: the declared model tests (model -> column -> tests)
# ---------------------------------------------------------------------------
RARITY_VALUES = ["SSR", "SR", "R"]
STATUS_VALUES = ["success", "failed", "refunded", "pending"]
BANNER_TYPE_VALUES = ["permanent", "limited"]

CHECK_SPEC: dict[str, list[tuple]] = {
    "stg_pulls": [
        ("id", "unique"), ("id", "not_null"), ("player_id", "not_null"), ("banner_id", "not_null"),
        ("character_id", "not_null"), ("rarity", "not_null"), ("rarity", "accepted_values", RARITY_VALUES),
        ("pulled_at", "not_null"),
    ],
    "stg_transactions": [
        ("id", "unique"), ("id", "not_null"), ("player_id", "not_null"), ("payment_status", "not_null"),
        ("payment_status", "accepted_values", STATUS_VALUES), ("transacted_at", "not_null"),
    ],
    "stg_players": [
        ("id", "unique"), ("id", "not_null"), ("username", "not_null"), ("region", "not_null"),
    ],
    "stg_player_pity": [
        ("id", "unique"), ("id", "not_null"), ("player_id", "not_null"), ("banner_type", "not_null"),
    ],
    "stg_player_inventory": [
        ("id", "unique"), ("id", "not_null"), ("player_id", "not_null"), ("character_id", "not_null"),
    ],
    "stg_characters": [
        ("id", "unique"), ("id", "not_null"), ("name", "not_null"), ("rarity", "not_null"),
        ("rarity", "accepted_values", RARITY_VALUES),
    ],
    "stg_banners": [
        ("id", "unique"), ("id", "not_null"), ("name", "not_null"), ("type", "not_null"),
        ("type", "accepted_values", BANNER_TYPE_VALUES),
    ],
    "fact_pulls": [
        ("pull_id", "unique"), ("pull_id", "not_null"), ("player_id", "not_null"), ("character_id", "not_null"),
        ("character_id", "relationships", "dim_characters", "character_id"), ("rarity", "not_null"),
        ("rarity", "accepted_values", RARITY_VALUES), ("pulled_at", "not_null"),
    ],
    "fact_transactions": [
        ("transaction_id", "unique"), ("transaction_id", "not_null"), ("player_id", "not_null"),
        ("payment_status", "not_null"), ("payment_status", "accepted_values", STATUS_VALUES),
        ("transacted_at", "not_null"),
    ],
    "dim_players": [
        ("player_id", "unique"), ("player_id", "not_null"), ("username", "not_null"), ("region", "not_null"),
    ],
    "dim_characters": [
        ("character_id", "unique"), ("character_id", "not_null"), ("rarity", "not_null"),
        ("rarity", "accepted_values", RARITY_VALUES), ("name", "not_null"),
    ],
    "dim_banners": [
        ("banner_id", "unique"), ("banner_id", "not_null"), ("name", "not_null"), ("type", "not_null"),
        ("type", "accepted_values", BANNER_TYPE_VALUES),
    ],
    "agg_player_spending": [
        ("player_id", "unique"), ("player_id", "not_null"), ("total_pulls", "not_null"),
        ("total_crystals_spent", "not_null"),
    ],
}

RESULT_SCHEMA = "model string, column string, test string, failures bigint, passed boolean"


# --- single checks (failing rows / groups) ----------------------------------


def check_unique(df: DataFrame, cols) -> DataFrame:
    """duplicated key values (nulls excluded), with their counts."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.where(cond).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_not_null(df: DataFrame, cols) -> DataFrame:
    """null counts for many columns in one pass (one row)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def check_accepted(df: DataFrame, col: str, values) -> DataFrame:
    """rows whose value is not accepted; nulls pass."""
    return df.where(~F.col(col).isin(list(values)))


def check_fk(child: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """child rows whose non-null key has no parent row."""
    p = parent.select(F.col(key).alias("_k")).distinct()
    return child.where(F.col(col).isNotNull()).join(p, F.col(col) == F.col("_k"), "left_anti")


# --- runner -----------------------------------------------------------------


def _model_checks(name: str, df: DataFrame, tests, tables) -> list[DataFrame]:
    out: list[DataFrame] = []
    # not_null + accepted_values: one aggregate for the whole model.
    aggs, labels = [], []
    for t in tests:
        col, kind = t[0], t[1]
        if kind == "not_null":
            aggs.append(F.count_if(F.col(col).isNull()).cast("bigint"))
            labels.append((col, "not_null"))
        elif kind == "accepted_values":
            bad = F.when(~F.col(col).isin(list(t[2])), F.col(col))
            aggs.append(F.count_distinct(bad).cast("bigint"))  # one failure per bad value
            labels.append((col, "accepted_values"))
    if aggs:
        row = df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)])
        stack = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(k).alias("test"), F.col(f"c{i}").alias("failures"))
                for i, (c, k) in enumerate(labels)
            ]
        )
        out.append(row.select(F.inline(stack)).select(F.lit(name).alias("model"), "*"))
    for t in tests:
        col, kind = t[0], t[1]
        if kind == "unique":
            n = check_unique(df, col).agg(F.count(F.lit(1)).alias("failures"))
            out.append(n.select(F.lit(name).alias("model"), F.lit(col).alias("column"), F.lit("unique").alias("test"), "failures"))
        elif kind == "relationships":
            n = check_fk(df, col, tables(t[2]), t[3]).agg(F.count(F.lit(1)).alias("failures"))
            out.append(
                n.select(F.lit(name).alias("model"), F.lit(col).alias("column"), F.lit("relationships").alias("test"), "failures")
            )
    return out


def run_checks(tables, spec=CHECK_SPEC) -> DataFrame:
    """one row per declared test: (model, column, test, failures, passed)."""
    parts: list[DataFrame] = []
    for model, tests in spec.items():
        parts.extend(_model_checks(model, tables(model), tests, tables))
    res = reduce(lambda a, b: a.unionByName(b), parts)
    return res.select(
        "model", "column", "test", F.col("failures").cast("bigint").alias("failures"),
        (F.col("failures") == 0).alias("passed"),
    )


# --- reconciliation -----------------------------------------------------------


def layer_counts(tables, names) -> DataFrame:
    """row count per layer table."""
    parts = [tables(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


def bronze_ids(bronze: DataFrame, table: str) -> DataFrame:
    """distinct ids of non-delete Bronze events of one table."""
    return bronze.where((F.col("source_table") == table) & (F.col("event") != "delete")).select("id").distinct()


#: One side-by-side comparison: table name, source rows, target rows, key columns.
Sides = tuple[str, DataFrame, DataFrame, Sequence[str]]

#: Ranges of a digest level: 2^RANGE_BITS of the keys' hash space.
RANGE_BITS = 12
#: Differing ranges of the second level up to this many go to the key scan by broadcast
#: (16 bytes each); beyond, the scan is narrowed by the first level alone.
MAX_LEAVES = 500_000
#: Rows per second-level range from which on its digests are fewer than its keys.
LEAF_ROWS = 16


def keyed_sides(sides: Sequence[Sides]) -> DataFrame:
    """(table, key, in_source) of all tables and both sides. Composite keys are
    concatenated with ':'; a missing half is empty."""
    out = []
    for table, source, target, keys in sides:
        for df, here in ((source, True), (target, False)):
            parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
            key = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(":")] if i else []) + [p]])
            out.append(df.select(F.lit(table).alias("table"), key.alias("key"), F.lit(here).alias("in_source")))
    return reduce(DataFrame.unionByName, out)


def _range(level: int) -> Column:
    """The hash range of a key on a level of the tree: its first ``level`` x RANGE_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64("key"), 64 - level * RANGE_BITS)


def differing_ranges(keyed: DataFrame, level: int) -> DataFrame:
    """Per (table, range): the ranges whose digests differ between the sides, and the
    rows of both in them. A digest
    is the number of rows and the sums of both halves of a second hash, which do not
    depend on order and see repeats; every task sends one row per range it met."""
    h = F.xxhash64("key", F.lit(level))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    sign = F.when(F.col("in_source"), 1).otherwise(-1)
    digest = [F.count(F.lit(1)).alias("rows"), F.sum(sign).alias("_n"), F.sum(sign * low).alias("_low"), F.sum(sign * high).alias("_high")]
    sums = keyed.groupBy("table", _range(level).alias("range")).agg(*digest)
    return sums.where((F.col("_n") != 0) | (F.col("_low") != 0) | (F.col("_high") != 0)).select("table", "range", "rows")


def _within(keyed: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    named = F.broadcast(ranges.select("table", "range"))
    return keyed.withColumn("range", _range(level)).join(named, ["table", "range"], "left_semi").drop("range")


def reconcile_tables(sides: Sequence[Sides], sample: int | None = None) -> DataFrame:
    """F8: key differences both ways of all tables, through a tree of range digests.

    The first level compares 4,096 hash ranges per table, the second, where that leaves
    :data:`LEAF_ROWS` rows or more per range, those that differ again 4,096-fold; only the
    keys of ranges that still differ are shuffled and compared. Where source and target
    agree nothing but digests moves. Repeats on one side make a
    range differ, not a key: the keys themselves are compared as sets. One row per
    differing key: (table, key, side) with side 'missing_in_target' or
    'extra_in_target'. ``sample`` keeps the first n keys per table and side in key order
    (the report view); None returns them all.
    """
    keyed = keyed_sides(sides)
    first = differing_ranges(keyed, 1).checkpoint()  # at most 4,096 rows a table
    narrowed = _within(keyed, first, 1)
    left = first.agg(F.count(F.lit(1)).alias("ranges"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    if left["rows"] >= LEAF_ROWS * left["ranges"] << RANGE_BITS:
        leaves = differing_ranges(narrowed, 2).checkpoint()
        if leaves.count() <= MAX_LEAVES:
            narrowed = _within(narrowed, leaves, 2)
    both = narrowed.groupBy("table", "key").agg(F.bool_or("in_source").alias("_s"), F.bool_and("in_source").alias("_only"))
    diff = both.where(F.col("_only") | ~F.col("_s")).select(
        "table", "key", F.when(F.col("_s"), "missing_in_target").otherwise("extra_in_target").alias("side")
    )
    if sample is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("table", "side").orderBy("key")
        diff = diff.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample).drop("_rn")
    return diff


def reconcile_ids(source: DataFrame, target: DataFrame, keys, table: str = "", sample: int | None = None) -> DataFrame:
    """F8 of one table, see :func:`reconcile_tables`."""
    return reconcile_tables([(table, source, target, [keys] if isinstance(keys, str) else list(keys))], sample)


def reconcile_report(sides: Sequence[Sides]) -> DataFrame:
    """F8/F9 summary row per table: distinct source keys, differences both ways,
    PASS/FAIL/SKIP. One aggregate by (table, key) over both sides of all tables."""
    both = keyed_sides(sides).groupBy("table", "key").agg(F.bool_or("in_source").alias("_s"), F.bool_and("in_source").alias("_only"))
    counts = both.groupBy("table").agg(
        F.count_if("_s").alias("source_keys"), F.count_if("_only").alias("missing_in_target"), F.count_if(~F.col("_s")).alias("extra_in_target")
    )
    names = counts.sparkSession.createDataFrame([(s[0],) for s in sides], "table string")  # one row per compared table
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("source_keys", "missing_in_target", "extra_in_target")]
    full = names.join(counts, "table", "left").select("table", *zero)
    return full.withColumn(
        "status",
        F.when(F.col("source_keys") == 0, "SKIP")
        .when((F.col("missing_in_target") == 0) & (F.col("extra_in_target") == 0), "PASS")
        .otherwise("FAIL"),
    )


def reconcile_summary(source: DataFrame, target: DataFrame, keys, table: str) -> DataFrame:
    """F8/F9 summary of one table, see :func:`reconcile_report`."""
    return reconcile_report([(table, source, target, [keys] if isinstance(keys, str) else list(keys))])


def layer_report(bronze: DataFrame, sides: Sequence[Sides]) -> DataFrame:
    """Source, Bronze and Silver side by side, one row per table: the reconciliation
    with the distinct non-delete Bronze ids and the Silver rows."""
    landed = bronze.where(F.col("event") != "delete").groupBy(F.col("source_table").alias("table")).agg(F.count_distinct("id").alias("bronze_ids"))
    rows = reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("silver_rows")).select(F.lit(name).alias("table"), "*") for name, _, t, _ in sides])
    report = reconcile_report(sides).join(landed, "table", "left").join(rows, "table", "left")
    return report.select("table", "source_keys", F.coalesce("bronze_ids", F.lit(0)).alias("bronze_ids"), "silver_rows", "missing_in_target", "extra_in_target", "status")


def verdict(summaries: DataFrame) -> DataFrame:
    """overall PASS when no table failed (SKIP does not fail)."""
    return summaries.agg(F.bool_and(F.col("status") != "FAIL").alias("all_passed"))

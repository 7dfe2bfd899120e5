"""Named queries: Spark callables ``(spark, sf_dir) -> DataFrame`` and their
DuckDB twins. Keys follow the section prefixes of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.operators import cdc, gold, merge, quality, silver
from cdcmart.plans import bi, dq_twins, incremental, models
from cdcmart.plans.bi_twins import BANNER_PERFORMANCE, BI_SQL
from cdcmart.plans.oracle import sql
from cdcmart.schemas import SILVER_SPECS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn

    return deco


def wh(spark: SparkSession, sf_dir: str) -> models.Warehouse:
    return models.warehouse(spark, sf_dir)


# ---------------------------------------------------------------------------
# CDC / Bronze
# ---------------------------------------------------------------------------


@register(
    "cdc_validate",
    "SELECT reason, source_table, row_id FROM dead_letters",
)
def q_cdc_validate(spark, sf_dir):
    """The dead letters with their reason and the row they carried."""
    d = wh(spark, sf_dir).table("dlq")
    m = F.try_parse_json("raw")
    return d.select(
        "reason",
        F.try_variant_get(m, "$.payload.source.table", "string").alias("source_table"),
        F.try_variant_get(m, "$.payload.after.id", "string").alias("row_id"),
    )


@register(
    "cdc_normalise",
    "SELECT id, event, event_timestamp, source_table, source_schema FROM bronze_keys",
)
def q_cdc_normalise(spark, sf_dir):
    """Every Bronze row's key, event and timestamp (all tables)."""
    return wh(spark, sf_dir).table("bronze").select("id", "event", "event_timestamp", "source_table", "source_schema")


@register(
    "cdc_bronze_counts",
    """
    SELECT source_table, event, count(*) AS events FROM bronze_keys GROUP BY source_table, event""",
)
def q_cdc_bronze_counts(spark, sf_dir):
    """Events per table and kind (Bronze partition pruning + group)."""
    return wh(spark, sf_dir).table("bronze").groupBy("source_table", "event").agg(F.count(F.lit(1)).alias("events"))


@register(
    "cdc_log_slice",
    """
    SELECT id, event, event_timestamp, source_table FROM bronze_keys
    WHERE source_table IN ('pulls', 'players') AND event_timestamp >= TIMESTAMP '2024-01-08' AND event_timestamp < TIMESTAMP '2024-01-22'""",
)
def q_cdc_log_slice(spark, sf_dir):
    """A3: two weeks of two tables out of the log, by its folders."""
    since, until = (F.lit(d).cast("timestamp") for d in ("2024-01-08", "2024-01-22"))
    rows = cdc.log_slice(wh(spark, sf_dir).log(), ["pulls", "players"], since, until, grain="month")
    return rows.select("id", "event", "event_timestamp", "source_table")


# ---------------------------------------------------------------------------
# Silver
# ---------------------------------------------------------------------------

for _t in ("pulls", "transactions", "players", "player_pity", "player_inventory", "characters", "banners"):

    def _mk(t):
        def q(spark, sf_dir):
            return wh(spark, sf_dir).table(f"stg_{t}")

        q.__doc__ = f"C: Silver stg_{t} (latest upsert per key)."
        return q

    register(f"silver_{_t}", f"SELECT * FROM stg_{_t}")(_mk(_t))


@register(
    "silver_latest_composite",
    """
    SELECT 'player_pity' AS "table", id, player_id, banner_type AS other, updated_at, pity_count AS amount FROM stg_player_pity
    UNION ALL
    SELECT 'player_inventory', id, player_id, character_id, updated_at, constellation FROM stg_player_inventory""",
)
def q_silver_latest_composite(spark, sf_dir):
    """The latest change of both composite-key tables, taken by their two key
    fields straight from the log and typed afterwards."""
    bronze = wh(spark, sf_dir).table("bronze")
    parts = []
    for table, other, amount in (("player_pity", "banner_type", "pity_count"), ("player_inventory", "character_id", "constellation")):
        latest = silver.latest_changes(bronze, table).select(F.col("_k0").alias("_a"), F.col("_k1").alias("_b"), "data")
        typed = silver.typed_rows(latest, SILVER_SPECS[table], keep=["_a", "_b"])
        parts.append(typed.select(
            F.lit(table).alias("table"), F.concat("_a", F.lit(":"), "_b").alias("id"), "player_id", F.col(other).alias("other"),
            "updated_at", F.col(amount).alias("amount"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _one_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of several tables as one, with the table's name."""
    parts = [t.select(F.lit(name).alias("table"), "*") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _one_table_sql(names: list[str], select: dict[str, str] | None = None, where: dict[str, str] | None = None) -> str:
    return "\nUNION ALL BY NAME ".join(
        f"SELECT '{n}' AS \"table\", {(select or {}).get(n, '*')} FROM {n} WHERE {(where or {}).get(n, 'true')}" for n in names
    )


# deletes come for every 17th pull
_ALIVE = _one_table_sql(models.SILVER_MODELS, where={"stg_pulls": "CAST(id AS BIGINT) % 17 <> 0"})


@register("silver_honor_deletes", _ALIVE)
def q_silver_honor_deletes(spark, sf_dir):
    """C1 option, all tables: rank deletes too, so a row whose latest event is a delete is gone."""
    return _one_table(silver.build_all(wh(spark, sf_dir).table("bronze"), honor_deletes=True))


# ---------------------------------------------------------------------------
# Merge (B8/B9) — incremental Silver equals the full rebuild
# ---------------------------------------------------------------------------

_CUTOFF = "2024-01-15 00:00:00"


@register("merge_upserts", _one_table_sql(models.SILVER_MODELS))
def q_merge_upserts(spark, sf_dir):
    """Silver of the first half of the log, merged with the second half, all tables."""
    b = wh(spark, sf_dir).table("bronze")
    early = silver.build_all(b.where(F.col("ingested_at") < F.lit(_CUTOFF).cast("timestamp")))
    late = silver.build_all(b.where(F.col("ingested_at") >= F.lit(_CUTOFF).cast("timestamp")))
    keys = {f"stg_{t}": spec.keys for t, spec in SILVER_SPECS.items()}
    return _one_table({n: merge.merge_upserts(early[n], late[n], keys[n]) for n in models.SILVER_MODELS})


@register("apply_deletes", _ALIVE)
def q_apply_deletes(spark, sf_dir):
    """Deletes from the log applied to Silver (order-aware), all tables."""
    w = wh(spark, sf_dir)
    log = w.table("bronze")
    out = {}
    for table, spec in SILVER_SPECS.items():
        mine = log.where(F.col("source_table") == table)
        out[f"stg_{table}"] = merge.apply_deletes(w.table(f"stg_{table}"), mine, spec.keys)
    return _one_table(out)


# ---------------------------------------------------------------------------
# Gold
# ---------------------------------------------------------------------------

for _g in ("fact_pulls", "fact_transactions", "dim_players", "dim_characters", "dim_banners"):

    def _mkg(t):
        def q(spark, sf_dir):
            return wh(spark, sf_dir).table(t)

        q.__doc__ = f"D: Gold {t}."
        return q

    register(f"gold_{_g}", f"SELECT * FROM {_g}")(_mkg(_g))


@register(
    "gold_agg_player_spending",
    """
    SELECT player_id, total_pulls, total_crystals_spent, round(total_usd_spent, 2) AS total_usd_spent,
           ssr_count, sr_count, r_count, unique_characters, round(avg_pity_to_ssr, 6) AS avg_pity_to_ssr
    FROM agg_player_spending""",
)
def q_gold_agg(spark, sf_dir):
    """D6-D9 (float columns rounded for a stable comparison)."""
    a = wh(spark, sf_dir).table("agg_player_spending")
    return a.withColumn("total_usd_spent", F.round("total_usd_spent", 2)).withColumn(
        "avg_pity_to_ssr", F.round("avg_pity_to_ssr", 6)
    )


@register("gold_agg_banner_performance")
def q_gold_banner_perf(spark, sf_dir):
    """Banner aggregate."""
    return gold.agg_banner_performance(wh(spark, sf_dir).table("fact_pulls"))


ORACLE["gold_agg_banner_performance"] = BANNER_PERFORMANCE


@register(
    "gold_dim_date",
    """
    SELECT d AS date_day, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
           CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day_of_month,
           CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
    FROM (SELECT CAST(unnest(generate_series(CAST(min(pulled_at) AS DATE), CAST(max(pulled_at) AS DATE),
                                             INTERVAL 1 DAY)) AS DATE) AS d FROM fact_pulls)""",
)
def q_gold_dim_date(spark, sf_dir):
    """Date dimension over the days of the pull facts."""
    return gold.dim_date_from(wh(spark, sf_dir).table("fact_pulls"))


@register(
    "gold_dim_players_scd2",
    "SELECT * FROM player_history",
)
def q_gold_scd2(spark, sf_dir):
    """SCD2 player history from the Bronze log."""
    return gold.dim_players_scd2(wh(spark, sf_dir).table("bronze"))


# ---------------------------------------------------------------------------
# BI (E1-E19)
# ---------------------------------------------------------------------------

for _name, _fn in bi.ALL.items():

    def _mkb(fn):
        def q(spark, sf_dir):
            return fn(wh(spark, sf_dir))

        q.__doc__ = fn.__doc__
        return q

    register(f"bi_{_name}")(_mkb(_fn))
    ORACLE[f"bi_{_name}"] = BI_SQL[_name]


# ---------------------------------------------------------------------------
# Quality and reconciliation
# ---------------------------------------------------------------------------


@register("dq_run_checks", dq_twins.twin(dq_twins.DECLARED))
def q_dq_run_checks(spark, sf_dir):
    """Every declared model test with its failure count."""
    return quality.run_checks(wh(spark, sf_dir).table)


#: Tests that the message log does not meet: several events per key, deletes, deleted or unlisted keys.
_BRONZE_SPEC = {
    "bronze": [
        ("id", "unique"), ("id", "not_null"), ("event", "accepted_values", ["insert", "update"]),
        ("id", "relationships", "stg_players", "id"), ("source_table", "not_null"),
    ]
}


@register("dq_bronze_checks", dq_twins.twin(dq_twins.BRONZE, {"bronze_keys": "bronze"}))
def q_dq_bronze_checks(spark, sf_dir):
    """F1-F5 over the message log, where the tests of each kind find failures."""
    return quality.run_checks(wh(spark, sf_dir).table, _BRONZE_SPEC)


@register(
    "dq_fk_violations",
    """
    SELECT fp.pull_id, fp.character_id FROM fact_pulls fp
    WHERE fp.character_id IS NOT NULL
      AND fp.character_id NOT IN (SELECT character_id FROM dim_characters)""",
)
def q_dq_fk(spark, sf_dir):
    """failing rows of the fact -> dimension relationship."""
    w = wh(spark, sf_dir)
    return quality.check_fk(w.table("fact_pulls"), "character_id", w.table("dim_characters"), "character_id").select(
        "pull_id", "character_id"
    )


@register(
    "dq_layer_counts",
    """
    SELECT 'bronze' AS "table", (SELECT count(*) FROM bronze_keys) AS "rows"
    UNION ALL SELECT 'dlq', (SELECT count(*) FROM dead_letters)
    """
    + "\n".join(f"UNION ALL SELECT '{t}', (SELECT count(*) FROM {t})" for t in models.SILVER_MODELS + models.GOLD_MODELS),
)
def q_dq_layer_counts(spark, sf_dir):
    """rows of every table of every layer."""
    return quality.layer_counts(wh(spark, sf_dir).table, models.MODEL_ORDER)


#: Key columns of the source tables; all other tables have ``id``.
_KEYS = {"player_pity": ["player_id", "banner_type"], "player_inventory": ["player_id", "character_id"]}
_LOST = "NOT (event_id % 5 = 0 OR (event_id % 101 <> 0 AND event_id % 103 <> 0))"
_DELETED = "event_id % 17 = 0"
_DIFFERENCES = f"""
    SELECT 'pulls' AS "table", id AS key,
           CASE WHEN {_DELETED} THEN 'extra_in_target' ELSE 'missing_in_target' END AS side
    FROM src_pulls WHERE ({_LOST}) <> ({_DELETED})"""


def _sides(spark, sf_dir):
    """(table, source rows, Silver rows, key columns) of all seven tables. The
    source has lost its deleted pulls, which Silver keeps. The source tables, which
    here are derived from the driver tables, were written by the build, as a source
    would hold them."""
    w = wh(spark, sf_dir)
    for name in sorted(m.removeprefix("stg_") for m in models.SILVER_MODELS):
        rows = w.source(name)
        if name == "pulls":
            rows = rows.where(F.col("event_id") % 17 != 0)
        yield name, rows, w.table(f"stg_{name}"), _KEYS.get(name, ["id"])


@register(
    "reconcile_ids",
    _DIFFERENCES,
)
def q_reconcile_ids(spark, sf_dir):
    """F8: source ids vs Silver ids of all tables, both ways, by range digests."""
    return quality.reconcile_tables(list(_sides(spark, sf_dir)))


def _summary_sql() -> str:
    parts = []
    for name in (m.removeprefix("stg_") for m in models.SILVER_MODELS):
        keys, lost, extra = "count(*)", "0", "0"
        if name == "pulls":
            keys = f"count(*) FILTER (WHERE NOT {_DELETED})"
            lost = f"count(*) FILTER (WHERE {_LOST} AND NOT {_DELETED})"
            extra = f"count(*) FILTER (WHERE NOT ({_LOST}) AND {_DELETED})"
        parts.append(
            f"""SELECT '{name}' AS "table", {keys} AS source_keys, {lost} AS missing_in_target, {extra} AS extra_in_target,
                CASE WHEN {keys} = 0 THEN 'SKIP' WHEN {lost} + {extra} = 0 THEN 'PASS' ELSE 'FAIL' END AS status
                FROM src_{name}"""
        )
    return "\nUNION ALL ".join(parts)


@register("reconcile_summary", _summary_sql())
def q_reconcile_summary(spark, sf_dir):
    """PASS/FAIL of each of the seven tables, composite keys included."""
    return quality.reconcile_report(list(_sides(spark, sf_dir)))


@register(
    "reconcile_layers",
    f"""
    SELECT s."table", source_keys, b.bronze_ids, r.silver_rows, missing_in_target, extra_in_target, status
    FROM ({_summary_sql()}) s
    JOIN (SELECT source_table, count(DISTINCT id) AS bronze_ids FROM bronze_keys WHERE event <> 'delete' GROUP BY 1) b ON b.source_table = s."table"
    JOIN ({" UNION ALL ".join(f"SELECT '{m.removeprefix('stg_')}' AS t, count(*) AS silver_rows FROM {m}" for m in models.SILVER_MODELS)}) r ON r.t = s."table"
    """,
)
def q_reconcile_layers(spark, sf_dir):
    """Source, Bronze and Silver of every table in one report."""
    return quality.layer_report(wh(spark, sf_dir).table("bronze"), list(_sides(spark, sf_dir)))


# Section modules register themselves on import.
from cdcmart.plans import q_rules  # noqa: E402,F401

from cdcmart.plans import q_governed  # noqa: E402,F401

from cdcmart.plans import q_misc  # noqa: E402,F401

from cdcmart.plans import q_stream  # noqa: E402,F401


@register("reconcile_verdict", f"SELECT bool_and(status <> 'FAIL') AS all_passed FROM ({_summary_sql()})")
def q_reconcile_verdict(spark, sf_dir):
    """overall verdict over the reconciliation of all tables."""
    return quality.verdict(QUERIES["reconcile_summary"](spark, sf_dir))


@register(
    "reconcile_samples",
    f"""
    SELECT "table", key, side FROM (
        SELECT *, row_number() OVER (PARTITION BY side ORDER BY key) AS rn FROM ({_DIFFERENCES}))
    WHERE rn <= 5""",
)
def q_reconcile_samples(spark, sf_dir):
    """F8 report view: at most 5 sample keys per table and side, in key order."""
    return quality.reconcile_tables(list(_sides(spark, sf_dir)), sample=5)


@register("bronze_ids", "SELECT DISTINCT source_table, id FROM bronze_keys WHERE event <> 'delete'")
def q_bronze_ids(spark, sf_dir):
    """distinct ids of the non-delete Bronze events of every table."""
    bronze = wh(spark, sf_dir).table("bronze")
    parts = [
        quality.bronze_ids(bronze, t).select(F.lit(t).alias("source_table"), "id")
        for t in (m.removeprefix("stg_") for m in models.SILVER_MODELS)
    ]
    return reduce(DataFrame.unionByName, parts)


# Two incremental runs: messages before / from the 15th (by their ts_ms).
_SPLIT_MS = 1705276800000  # 2024-01-15 00:00:00 UTC


_INCR: dict[tuple, str] = {}


def _incremental(spark, sf_dir):
    """Run the two incremental batches once per (data, shared folder); the
    Silver and Gold queries read the same result."""
    import os
    import uuid

    from cdcmart.session import work_dir
    from cdcmart.sources import adapter
    from cdcmart.sources.tables import fingerprint

    key = (os.path.realpath(sf_dir), fingerprint(spark, sf_dir), work_dir(spark))
    if key in _INCR:
        return incremental.IncrementalWarehouse(spark, _INCR[key])

    root = f"{work_dir(spark)}/cdcmart-incr-{uuid.uuid4().hex[:10]}"
    # the message log is produced once, in a folder per run
    ts = F.get_json_object(F.col("value").cast("string"), "$.payload.ts_ms").cast("long")
    batch = F.when(F.coalesce(ts < _SPLIT_MS, F.lit(True)), 0).otherwise(1)
    made = adapter.cdc_messages(adapter.source_tables(spark, sf_dir)).withColumn("batch", batch)
    adapter.write_messages(made, f"{root}/messages", ("batch",))
    msgs = spark.read.schema(made.schema).parquet(f"{root}/messages")
    stamp = F.col("event_timestamp")
    for n in (0, 1):
        of_run = msgs.where(F.col("batch") == n).select("value")
        wh = incremental.run_incremental(spark, of_run, root, n, ingested_at=stamp, grain="year")
    _INCR[key] = wh.root
    return wh


@register("incremental_silver", _one_table_sql(models.SILVER_MODELS))
def q_incremental_silver(spark, sf_dir):
    """The seven Silver tables after two incremental runs equal the full build."""
    wh = _incremental(spark, sf_dir)
    return _one_table({n: wh.table(n) for n in models.SILVER_MODELS})


_SPENDING = "* REPLACE (round(total_usd_spent, 2) AS total_usd_spent, round(avg_pity_to_ssr, 6) AS avg_pity_to_ssr)"


@register("incremental_gold", _one_table_sql(models.GOLD_MODELS, {"agg_player_spending": _SPENDING}))
def q_incremental_gold(spark, sf_dir):
    """The six Gold tables, patched by the changes of two runs, equal the full build."""
    wh = _incremental(spark, sf_dir)
    tables = {n: wh.table(n) for n in models.GOLD_MODELS}
    rounded = {"total_usd_spent": F.round("total_usd_spent", 2), "avg_pity_to_ssr": F.round("avg_pity_to_ssr", 6)}
    tables["agg_player_spending"] = tables["agg_player_spending"].withColumns(rounded)
    return _one_table(tables)


@register("incremental_history", "SELECT * FROM player_history")
def q_incremental_history(spark, sf_dir):
    """The player history merged from two runs' changes equals the full build."""
    return _incremental(spark, sf_dir).table(incremental.HISTORY)


@register(
    "fact_pulls_history",
    """
    SELECT f.pull_id, f.player_id, f.pulled_at, h.region AS region_at_pull, h.valid_from AS version_from
    FROM fact_pulls f LEFT JOIN player_history h
      ON f.player_id = h.player_id AND f.pulled_at >= h.valid_from AND (h.valid_to IS NULL OR f.pulled_at < h.valid_to)""",
)
def q_fact_pulls_history(spark, sf_dir):
    """Every pull with the player's region at that time (point-in-time join)."""
    w = wh(spark, sf_dir)
    return gold.fact_pulls_asof(w.table("fact_pulls"), gold.dim_players_scd2(w.table("bronze")))

"""Incremental runs (A6): Silver and Gold patched by what a batch changes.

Every table is a folder of runs, ``<table>/run=<n>``, that hold the changes of that run
as (key, row, was); a table is the newest row of every key over the runs that were
published. A run reads earlier runs only (those of the touched keys), so it can be
repeated until it is published, and what it writes grows with its changes. A run is
published by a marker written after everything else; tables that it did not touch
get no files.

    Silver   latest change per key, if later than the one held
    dims,    projections of the changed Silver rows
    fact_transactions
    fact_pulls   changed pulls, and the pulls of players whose region changed
    agg_player_spending   signed sums of the fact changes, added to the totals held
    dim_players_history   versions of the changed players (D10)
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.operators import cdc, delta, gold, silver
from cdcmart.plans.models import GOLD_MODELS, SILVER_MODELS, Warehouse, gold_from, in_parallel
from cdcmart.schemas import BRONZE_SCHEMA, SILVER_SPECS
from cdcmart.session import path_exists

#: Gold tables that are projections of one Silver table: function, Silver table, key.
PROJECTIONS = {
    "fact_transactions": (gold.fact_transactions, "stg_transactions", "transaction_id"),
    "dim_players": (gold.dim_players, "stg_players", "player_id"),
    "dim_characters": (gold.dim_characters, "stg_characters", "character_id"),
    "dim_banners": (gold.dim_banners, "stg_banners", "banner_id"),
}
HISTORY = "dim_players_history"


class IncrementalWarehouse(Warehouse):
    """The published result of incremental runs under one root folder."""

    #: The runs published when the run at work began, listed once.
    pinned: list[int] | None = None

    def runs(self) -> list[int]:
        """Published runs."""
        if not path_exists(self.spark, self.path("_runs")):
            return []
        return sorted(int(r[0]) for r in self.spark.read.text(self.path("_runs/run=*")).collect())  # one row per run

    def publish(self, run: int) -> None:
        marker = self.spark.createDataFrame([(str(run),)], "value string").coalesce(1)
        marker.write.mode("overwrite").text(self.path(f"_runs/run={run}"))

    def versions(self, name: str, also: int | None = None) -> DataFrame | None:
        """(key, row, was, run) of the published runs, and of ``also``, the run at work;
        None where no run touched the table. What a run that was never published left
        behind is not read."""
        if not path_exists(self.spark, self.path(name)):
            return None
        seen = [*(self.runs() if self.pinned is None else self.pinned), *([] if also is None else [also])]
        return self.spark.read.parquet(self.path(name)).where(F.col("run").isin(seen))

    def rows(self, name: str, also: int | None = None) -> DataFrame | None:
        held = self.versions(name, also)
        return None if held is None else delta.newest(held).where(F.col("row").isNotNull())

    def changes(self, name: str, run: int) -> DataFrame | None:
        path = self.path(f"{name}/run={run}")
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def silver(self, name: str, also: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """A Silver table; ``of``: of these keys only."""
        held = self.versions(name, also)
        if held is None:
            return empty_silver(self.spark, name)
        return typed(delta.newest(held if of is None else delta.of_keys(held, of)), name)

    def table(self, name: str) -> DataFrame:
        if name in SILVER_MODELS:
            return self.silver(name)
        if name == "agg_player_spending":
            totals = self.rows("player_totals")
            return spending(totals) if totals is not None else gold_from(lambda n: empty_silver(self.spark, n))[name]
        if name in GOLD_MODELS:
            held = self.rows(name)
            return held.select("row.*") if held is not None else gold_from(lambda n: empty_silver(self.spark, n))[name]
        if name == HISTORY:
            held = self.rows(name)
            return (held.select("row.*") if held is not None else gold.empty_history(self.spark)).drop("seq")
        raise KeyError(name)

    __call__ = table


def empty_silver(spark: SparkSession, name: str) -> DataFrame:
    return silver.build_silver(spark.createDataFrame([], BRONZE_SCHEMA), name.removeprefix("stg_"))


def typed(changes: DataFrame, name: str, side: str = "row") -> DataFrame:
    """Silver rows of one side of Silver changes; deleted rows are gone."""
    there = changes.where(F.col(side).isNotNull() & (F.col(f"{side}.event") != "delete"))
    return silver.typed_rows(there, SILVER_SPECS[name.removeprefix("stg_")], f"{side}.data")


def spending(totals: DataFrame) -> DataFrame:
    """``agg_player_spending`` (D9) of the totals held per player."""
    r = F.col("row")
    paid = F.when(r["player_id"].isNull(), 0.0).otherwise(r["usd"])  # payments of nobody join no player
    return totals.where(r["pulls"] > 0).select(
        r["player_id"].alias("player_id"), r["pulls"].alias("total_pulls"),
        F.when(r["crystals_n"] > 0, r["crystals"]).alias("total_crystals_spent"), paid.alias("total_usd_spent"),
        r["ssr"].alias("ssr_count"), r["sr"].alias("sr_count"), r["r"].alias("r_count"),
        r["characters"].alias("unique_characters"), F.when(r["pity_n"] > 0, r["pity"] / r["pity_n"]).alias("avg_pity_to_ssr"),
    )


class _Run:
    def __init__(self, wh: IncrementalWarehouse, run: int, honor_deletes: bool) -> None:
        self.wh, self.run, self.honor_deletes = wh, run, honor_deletes

    def before(self, name: str, keys: DataFrame) -> DataFrame | None:
        """(key, row) of the given keys after the last run."""
        held = self.wh.versions(name)
        return None if held is None else delta.newest(delta.of_keys(held, keys))

    def write(self, name: str, changes: DataFrame) -> DataFrame:
        path = self.wh.path(f"{name}/run={self.run}")
        changes.write.mode("overwrite").parquet(path)
        return self.wh.spark.read.parquet(path)

    def merge_silver(self, bronze: DataFrame, name: str) -> None:
        spec = SILVER_SPECS[name.removeprefix("stg_")]
        latest = silver.latest_changes(bronze, spec, self.honor_deletes)
        keys = [f"_k{i}" for i in range(len(spec.keys))]
        new = latest.select(delta.key_of(*keys).alias("key"), F.struct(*silver.DEFAULT_ORDER).alias("row"))
        self.write(name, delta.accept(new, self.before(name, new)))

    def project(self, name: str) -> None:
        make, source, key = PROJECTIONS[name]
        changes = self.wh.changes(source, self.run)
        if changes is not None:
            self.write(name, delta.pair(make(typed(changes, source)), make(typed(changes, source, "was")), [key]))

    def fact_pulls(self) -> None:
        pulls, players = self.wh.changes("stg_pulls", self.run), self.wh.changes("stg_players", self.run)
        if pulls is None and players is None:
            return
        held = self.wh.versions("fact_pulls")
        if pulls is None and held is None:
            return
        touched, rows = [], []
        if pulls is not None:
            touched.append(pulls.select("key"))
            none = empty_silver(self.wh.spark, "stg_players")
            rows.append(gold.fact_pulls(typed(pulls, "stg_pulls"), none))
        if players is not None and held is not None:
            new, old = (typed(players, "stg_players", side).select("id", "region") for side in ("row", "was"))
            both = new.withColumnRenamed("region", "to").join(old.withColumnRenamed("region", "at"), "id", "full_outer")
            moved = both.where(~F.col("to").eqNullSafe(F.col("at"))).select(F.col("id").alias("player_id"))
            theirs = held.where(F.col("row").isNotNull()).select("key", F.col("row.player_id").alias("player_id"))
            touched.append(theirs.join(moved, "player_id", "left_semi").select("key"))
        keys = reduce(DataFrame.unionByName, touched).distinct()
        old_rows = delta.newest(delta.of_keys(held, keys)) if held is not None else None
        if old_rows is not None:
            kept = old_rows if pulls is None else old_rows.join(pulls.select("key"), "key", "left_anti")
            rows.append(kept.where(F.col("row").isNotNull()).select("row.*"))
        now = reduce(DataFrame.unionByName, rows)
        columns = now.columns
        now = now.drop("player_region")
        theirs = now.select(delta.key_of("player_id").alias("key")).distinct()
        regions = self.wh.silver("stg_players", self.run, theirs).select(F.col("id").alias("player_id"), F.col("region").alias("player_region"))
        now = now.join(regions, "player_id", "left").select(*columns)
        was = old_rows.where(F.col("row").isNotNull()).select("row.*") if old_rows is not None else now.limit(0)
        self.write("fact_pulls", delta.pair(now, was.select(*columns), ["pull_id"]))

    def spending(self) -> None:
        pulls, paid = self.wh.changes("fact_pulls", self.run), self.wh.changes("fact_transactions", self.run)
        parts: list[DataFrame] = []
        sums = ["pulls", "crystals", "crystals_n", "ssr", "sr", "r", "pity", "pity_n", "usd", "characters"]

        def totals(made: DataFrame) -> DataFrame:
            missing = [F.lit(0.0 if c == "usd" else 0).cast("double" if c == "usd" else "long").alias(c) for c in sums if c not in made.columns]
            return made.select("player_id", "*", *missing).select("player_id", *sums) if missing else made.select("player_id", *sums)

        if pulls is not None:
            s, rarity = F.col("sign"), F.col("rarity")
            rows = delta.signed(pulls)
            pity = (rarity == "SSR") & F.col("pity_count").isNotNull()
            parts.append(totals(rows.groupBy("player_id").agg(
                F.sum("sign").alias("pulls"), F.sum(s * F.coalesce("crystals_spent", F.lit(0))).alias("crystals"),
                F.sum(F.when(F.col("crystals_spent").isNotNull(), s).otherwise(0)).alias("crystals_n"),
                *[F.sum(F.when(rarity == v, s).otherwise(0)).alias(v.lower()) for v in ("SSR", "SR", "R")],
                F.sum(F.when(pity, s * F.col("pity_count")).otherwise(0)).alias("pity"), F.sum(F.when(pity, s).otherwise(0)).alias("pity_n"),
            )))
            counts = rows.where(F.col("character_id").isNotNull()).groupBy("player_id", "character_id").agg(F.sum("sign").alias("n"))
            member = counts.select(delta.key_of("player_id", "character_id").alias("key"))
            held = self.before("player_characters", member)
            patched = self.write("player_characters", delta.patch_sums(held, counts, ["player_id", "character_id"], ["n"]))
            parts.append(totals(delta.distinct_delta(held, patched, ["player_id"], "characters")))
        if paid is not None:
            good = delta.signed(paid).where(F.col("payment_status") == "success")
            parts.append(totals(good.groupBy("player_id").agg(F.sum(F.col("sign") * F.coalesce("amount_usd", F.lit(0.0))).alias("usd"))))
        if not parts:
            return
        moved = reduce(DataFrame.unionByName, parts).groupBy("player_id").agg(*[F.sum(c).alias(c) for c in sums])
        held = self.before("player_totals", moved.select(delta.key_of("player_id").alias("key")))
        self.write("player_totals", delta.patch_sums(held, moved, ["player_id"], sums))

    def history(self, log: DataFrame, batch: DataFrame) -> None:
        changed = gold.player_changes(batch)
        made = gold.merge_history(self.wh.rows(HISTORY), gold.player_changes(log), changed)
        self.write(HISTORY, made)


def run_incremental(
    spark: SparkSession,
    messages: DataFrame,
    root: str,
    batch_id: int,
    honor_deletes: bool = False,
    ingested_at=None,
    grain: str = "day",
) -> IncrementalWarehouse:
    """One incremental run: route the new messages (``cdc_batches/batch=<id>``), patch
    Silver and Gold, publish. A run that was published before changes nothing; run
    numbers rise."""
    wh = IncrementalWarehouse(spark, root)
    done = wh.runs()
    if batch_id in done:
        return wh
    if done and batch_id < done[-1]:
        raise ValueError(f"run {batch_id} comes before published run {done[-1]}")
    batch_dir = wh.path(f"cdc_batches/batch={batch_id}")
    routed = cdc.route(messages, ingested_at=ingested_at, tables=list(SILVER_SPECS))
    cdc.write_log(routed, batch_dir, grain)
    wh.pinned = done
    run = _Run(wh, batch_id, honor_deletes)
    if path_exists(spark, f"{batch_dir}/route=bronze"):
        new = _bronze(spark, batch_dir)
        present = {r[0] for r in new.select("source_table").distinct().collect()}  # one row per table
        touched = [n for n in SILVER_MODELS if n.removeprefix("stg_") in present]
        in_parallel([partial(run.merge_silver, new, n) for n in touched])
        jobs = [partial(run.project, n) for n in PROJECTIONS] + [run.fact_pulls]
        if "players" in present:
            folders = [wh.path(f"cdc_batches/batch={n}") for n in [*done, batch_id]]
            logs = [_bronze(spark, f) for f in folders if path_exists(spark, f"{f}/route=bronze/source_table=players")]
            jobs.append(partial(run.history, reduce(DataFrame.unionByName, logs), new))
        in_parallel(jobs)
        run.spending()
    wh.publish(batch_id)
    wh.pinned = None
    return wh


def _bronze(spark: SparkSession, batch_dir: str) -> DataFrame:
    path = f"{batch_dir}/route=bronze"
    return spark.read.option("basePath", path).parquet(path).select(*cdc.BRONZE_COLS)

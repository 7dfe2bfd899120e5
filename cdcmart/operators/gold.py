"""Gold star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fact_pulls(stg_pulls: DataFrame, stg_players: DataFrame) -> DataFrame:
    """Pulls left-joined to the player's region.

    Only (id, region) of players is read. The join strategy is left to
    Catalyst/AQE: broadcast when the player side is below the broadcast
    threshold at runtime, sort-merge (with skew splitting) otherwise.
    """
    pl = stg_players.select(F.col("id").alias("_pid"), F.col("region").alias("player_region"))
    p = stg_pulls
    return p.join(pl, p["player_id"] == pl["_pid"], "left").select(
        p["id"].alias("pull_id"),
        p["player_id"],
        "player_region",
        p["banner_id"],
        p["character_id"],
        p["rarity"],
        p["pity_count"],
        p["is_guaranteed"],
        p["crystals_spent"],
        p["pulled_at"],
    )


def fact_transactions(stg_transactions: DataFrame) -> DataFrame:
    """D2"""
    return stg_transactions.select(
        F.col("id").alias("transaction_id"),
        "player_id",
        "package_id",
        "crystals_added",
        "amount_usd",
        "payment_method",
        "payment_status",
        "is_first_buy",
        "transacted_at",
    )


def dim_players(stg_players: DataFrame) -> DataFrame:
    """D3 (no history; see :func:`dim_players_scd2`)."""
    return stg_players.select(
        F.col("id").alias("player_id"), "username", "region", "crystal_balance", "registered_at"
    )


def dim_characters(stg_characters: DataFrame) -> DataFrame:
    """D4 (drops faction)."""
    return stg_characters.select(
        F.col("id").alias("character_id"), "name", "rarity", "archetype", "element", "banner_debut"
    )


def dim_banners(stg_banners: DataFrame) -> DataFrame:
    """D5"""
    return stg_banners.select(
        F.col("id").alias("banner_id"), "name", "type", "version", "rate_up_ssr_id", "start_date", "end_date"
    )


def pull_stats(fact: DataFrame) -> DataFrame:
    """D6 + D7 in one pass over the pulls (the source models scan twice)."""
    ssr = F.col("rarity") == "SSR"
    return fact.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("total_pulls"),
        F.sum("crystals_spent").alias("total_crystals_spent"),
        F.count_if(ssr).alias("ssr_count"),
        F.count_if(F.col("rarity") == "SR").alias("sr_count"),
        F.count_if(F.col("rarity") == "R").alias("r_count"),
        F.count_distinct("character_id").alias("unique_characters"),
        F.avg(F.when(ssr, F.col("pity_count"))).alias("avg_pity_to_ssr"),
    )


def spend_stats(fact_tx: DataFrame) -> DataFrame:
    """Successful spend per player."""
    return (
        fact_tx.where(F.col("payment_status") == "success")
        .groupBy("player_id")
        .agg(F.sum("amount_usd").alias("total_usd_spent"))
    )


def agg_player_spending(fact: DataFrame, fact_tx: DataFrame) -> DataFrame:
    """Pull stats left-joined to spend; payers without pulls are absent.

    Both sides are pre-aggregated to one row per player before the join, so
    a hot player cannot fan out.
    """
    ps = pull_stats(fact)
    ss = spend_stats(fact_tx)
    return ps.join(ss, "player_id", "left").select(
        "player_id",
        "total_pulls",
        "total_crystals_spent",
        F.coalesce(F.col("total_usd_spent"), F.lit(0.0)).alias("total_usd_spent"),
        "ssr_count",
        "sr_count",
        "r_count",
        "unique_characters",
        "avg_pity_to_ssr",
    )


# --- D10: documented extensions -------------------------------------------


#: Change order of one player's events.
_CHANGE_ORDER = ["event_timestamp", "ingested_at", "data"]


def player_changes(bronze: DataFrame) -> DataFrame:
    """The upserts of players in the log, with the columns that history follows."""
    j = F.from_json("data", "id string, region string, username string")
    rows = bronze.where((F.col("source_table") == "players") & F.col("event").isin("insert", "update"))
    return rows.select(j.alias("_j"), *_CHANGE_ORDER).select(
        F.col("_j.id").alias("player_id"), F.col("_j.username").alias("username"), F.col("_j.region").alias("region"), *_CHANGE_ORDER
    )


def _versions(changes: DataFrame) -> DataFrame:
    """Versions of every player: one starts where the region differs (nulls are a
    region) from the player's previous change and ends where the next starts. Rows
    with ``known`` only say what came before and open no version. The lag and lead are
    segmented scans, so no player is gathered into one task."""
    from cdcmart.operators.scan import segmented_scan

    # the previous region in a struct: an earlier row with a null region is not "no earlier row"
    prev = segmented_scan(changes, ["player_id"], _CHANGE_ORDER, {"_prev": ("last", F.struct("region"), False)})
    opened = ~F.col("known") & (F.col("_prev").isNull() | ~F.col("_prev.region").eqNullSafe(F.col("region")))
    starts = prev.where(opened).drop("_prev", "known")
    nxt = segmented_scan(
        starts, ["player_id"], [F.desc(c) for c in _CHANGE_ORDER], {"valid_to": ("last", F.col("event_timestamp"), False)}
    )
    return nxt.select(
        "player_id", "username", "region", F.col("event_timestamp").alias("valid_from"), "valid_to",
        F.col("valid_to").isNull().alias("is_current"), F.xxhash64("ingested_at", "data").alias("seq"),
    )


def dim_players_scd2(bronze: DataFrame) -> DataFrame:
    """SCD2 player history on region from the Bronze log."""
    return _versions(player_changes(bronze).withColumn("known", F.lit(False))).drop("seq")


def empty_history(spark) -> DataFrame:
    return spark.createDataFrame([], "player_id string, username string, region string, valid_from timestamp, "
                                     "valid_to timestamp, is_current boolean, seq long")


def merge_history(held: DataFrame | None, log: DataFrame, changed: DataFrame) -> DataFrame:
    """The changes (key, row, was) that a batch makes to a history of versions.

    ``held``: the history so far as (key, row); ``log``: all player changes, the
    batch's among them; ``changed``: those of the batch, in any order and of any age.
    Per touched player, the versions that start before the last one older than the
    batch's first event stay; from that version on the player's log is judged again.
    In an ordered log that closes the open version and opens new ones; a late event
    splits the version it falls into. Untouched players cost nothing but the scan.
    """
    from cdcmart.operators.delta import key_of, pair

    keyed = [c.withColumn("key", key_of("player_id")) for c in (log, changed)]
    first = keyed[1].groupBy("key").agg(F.min("event_timestamp").alias("_first"))
    versions = empty_history(log.sparkSession) if held is None else held.select("row.*")
    theirs = versions.withColumn("key", key_of("player_id")).join(first, "key")
    pivot = theirs.where(F.col("valid_from") < F.col("_first")).groupBy("key").agg(F.max("valid_from").alias("_pivot"))
    theirs = theirs.drop("_first").join(pivot, "key", "left")
    before = F.col("_pivot").isNotNull() & (F.col("valid_from") < F.col("_pivot"))
    # of what stays, the version that ends at the pivot says which region came before
    context = theirs.where(before & (F.col("valid_to") == F.col("_pivot"))).select(
        "player_id", "username", "region", F.col("valid_from").alias("event_timestamp"),
        F.col("valid_from").alias("ingested_at"), F.lit("").alias("data"), F.lit(True).alias("known"),
    )
    judged = keyed[0].join(first, "key", "left_semi").join(pivot, "key", "left")
    judged = judged.where(F.col("_pivot").isNull() | (F.col("event_timestamp") >= F.col("_pivot")))
    new = _versions(judged.drop("key", "_pivot").withColumn("known", F.lit(False)).unionByName(context))
    return pair(new, theirs.where(~before).drop("key", "_pivot"), ["player_id", "valid_from", "seq"])


def fact_pulls_asof(fact: DataFrame, history: DataFrame) -> DataFrame:
    """Pulls with the player's region at the time of the pull (point-in-time join).

    Versions and pulls are one stream per player in time order, in which every pull
    takes the last version before it: a segmented scan, linear in both sides, where a
    range join would pair every pull of a player with every version.
    """
    from cdcmart.operators.scan import segmented_scan

    spans = history.where(F.col("player_id").isNotNull() & (F.col("is_current") | (F.col("valid_to") > F.col("valid_from"))))
    none = F.lit(None).cast("string")
    events = spans.select(
        "player_id", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), none.alias("pull_id"), F.struct("region", "valid_from").alias("version")
    ).unionByName(fact.select("player_id", F.col("pulled_at").alias("at"), F.lit(1).alias("kind"), "pull_id"), allowMissingColumns=True)
    seen = segmented_scan(events, ["player_id"], ["at", "kind", "pull_id"], {"held": ("last", F.col("version"), True)})
    return seen.where(F.col("kind") == 1).select(
        "pull_id", "player_id", F.col("at").alias("pulled_at"), F.col("held.region").alias("region_at_pull"),
        F.col("held.valid_from").alias("version_from"),
    )


def dim_date(spark, start: str, end: str) -> DataFrame:
    """Date dimension from ``start`` to ``end`` (inclusive)."""
    return spark.sql(
        f"""
        SELECT d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month,
               day(d) AS day_of_month, dayofweek(d) AS day_of_week,
               dayofweek(d) IN (1, 7) AS is_weekend
        FROM (SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS d)
        """
    )


def dim_date_from(fact: DataFrame, time_col: str = "pulled_at") -> DataFrame:
    """Date dimension spanning the days of a fact table."""
    b = fact.agg(F.min(F.to_date(time_col)).alias("lo"), F.max(F.to_date(time_col)).alias("hi"))
    d = b.select(F.explode(F.sequence("lo", "hi")).alias("date_day"))
    return d.select(
        "date_day",
        F.year("date_day").alias("year"),
        F.quarter("date_day").alias("quarter"),
        F.month("date_day").alias("month"),
        F.dayofmonth("date_day").alias("day_of_month"),
        F.dayofweek("date_day").alias("day_of_week"),
        F.dayofweek("date_day").isin(1, 7).alias("is_weekend"),
    )


def agg_banner_performance(fact: DataFrame) -> DataFrame:
    """Per banner: pulls, SSR pulls, players, SSR rate, crystals."""
    return fact.groupBy("banner_id").agg(
        F.count(F.lit(1)).alias("total_pulls"),
        F.count_if(F.col("rarity") == "SSR").alias("ssr_pulls"),
        F.count_distinct("player_id").alias("players_pulled"),
        F.sum("crystals_spent").alias("crystals_spent"),
        F.round(F.count_if(F.col("rarity") == "SSR") * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("ssr_rate"),
    )

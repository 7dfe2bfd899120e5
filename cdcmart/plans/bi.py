"""The 19 named BI queries (E1-E19) on Gold plus ``stg_players``.

Each takes a table accessor ``t(name) -> DataFrame`` and returns a lazy
DataFrame. Ratios are DOUBLE; every ``limit`` has a unique tie-breaker so
the top-k is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcmart.functions.columns import pct

Tables = Callable[[str], DataFrame]

def _ssr():
    return F.col("rarity") == "SSR"


def _rank(col, values) -> F.Column:
    expr = None
    for i, v in enumerate(values, start=1):
        expr = F.when(col == v, i) if expr is None else expr.when(col == v, i)
    return expr


def overview(t: Tables) -> DataFrame:
    """E1"""
    return t("fact_pulls").agg(
        F.count_distinct("player_id").alias("total_players"),
        F.count(F.lit(1)).alias("total_pulls"),
        F.count_if(_ssr()).alias("total_ssr"),
        pct(F.count_if(_ssr()), F.count(F.lit(1))).alias("ssr_rate"),
        F.sum("crystals_spent").alias("total_crystals_spent"),
    )


def total_spent(t: Tables) -> DataFrame:
    """E2 (currency, rounded to cents as displayed)."""
    return (
        t("fact_transactions")
        .where(F.col("payment_status") == "success")
        .agg(F.round(F.coalesce(F.sum("amount_usd"), F.lit(0.0)), 2).alias("total_revenue_usd"))
    )


def rarity_dist(t: Tables) -> DataFrame:
    """E3"""
    return (
        t("fact_pulls")
        .groupBy("rarity")
        .agg(F.count(F.lit(1)).alias("pulls"))
        .orderBy(_rank(F.col("rarity"), RARITY_ORDER).asc_nulls_last())
    )


def region_pulls(t: Tables) -> DataFrame:
    """A null region (pull of an unknown player) is its own group."""
    return (
        t("fact_pulls")
        .groupBy(F.col("player_region").alias("region"))
        .agg(
            F.count(F.lit(1)).alias("pulls"),
            F.count_if(_ssr()).alias("ssr_pulls"),
            pct(F.count_if(_ssr()), F.count(F.lit(1))).alias("ssr_rate"),
        )
        .orderBy(F.desc("pulls"))
    )


def payment_methods(t: Tables) -> DataFrame:
    """E5"""
    return (
        t("fact_transactions")
        .where(F.col("payment_status") == "success")
        .groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("transactions"), F.round(F.sum("amount_usd"), 2).alias("total_usd"))
        .orderBy(F.desc_nulls_last("total_usd"))
    )


def _luck(t: Tables, ascending: bool, n: int) -> DataFrame:
    a = t("agg_player_spending").where(F.col("ssr_count") > 0)
    p = t("stg_players").select(F.col("id").alias("_pid"), "username", "region")
    order = F.asc_nulls_last("avg_pity_to_ssr") if ascending else F.desc_nulls_last("avg_pity_to_ssr")
    return (
        a.join(p, a["player_id"] == p["_pid"], "inner")
        .orderBy(order, F.asc("player_id"))
        .limit(n)
        .select(
            "player_id",
            "username",
            "region",
            "total_pulls",
            "ssr_count",
            F.round("avg_pity_to_ssr", 1).alias("avg_pity"),
            pct(F.col("ssr_count"), F.col("total_pulls")).alias("ssr_rate"),
        )
    )


def luckiest(t: Tables, n: int = 20) -> DataFrame:
    """Top-n lowest average pity at SSR."""
    return _luck(t, True, n)


def unluckiest(t: Tables, n: int = 20) -> DataFrame:
    """Top-n highest average pity at SSR."""
    return _luck(t, False, n)


# ---------------------------------------------------------------------------
# FIXED VALUES: dashboard labels and bucket bounds
# ---------------------------------------------------------------------------
RARITY_ORDER = ["SSR", "SR", "R"]
FIFTY_FIFTY = {True: "Won 50/50", False: "Lost 50/50 (guaranteed)"}
# (least value of the range, label)
PITY_BUCKETS = [
    (1, "1-10 (early)"),
    (11, "11-30"),
    (31, "31-50"),
    (51, "51-73"),
    (74, "74-89 (soft pity)"),
    (90, "90 (hard pity)"),
]
# (spending below which the tier holds, label); the first is for spending of zero
TIERS = [(0, "F2P"), (50, "Minnow (<$50)"), (200, "Dolphin ($50-200)"), (None, "Whale ($200+)")]
# (least value of the range, label)
COLLECTION = [(0, "1-4"), (5, "5-9"), (10, "10-14"), (15, "15-20"), (21, "Complete (21/21)")]


def _range_label(c: F.Column, ranges) -> F.Column:
    """Label of the last range whose least value is not above ``c``, else null."""
    expr = F
    for least, label in reversed(ranges):
        expr = expr.when(c >= least, label)
    return expr


def pity_bucket(c) -> F.Column:
    return _range_label(c, PITY_BUCKETS)


def pity_histogram(t: Tables) -> DataFrame:
    """Counts below 1 fall in the null bucket."""
    return (
        t("fact_pulls")
        .where(_ssr())
        .groupBy(pity_bucket(F.col("pity_count")).alias("pity_range"))
        .agg(F.count(F.lit(1)).alias("ssr_pulls"), F.min("pity_count").alias("_o"))
        .orderBy(F.asc_nulls_last("_o"))
        .drop("_o")
    )


def high_pity_players(t: Tables, min_pity: int = 75, n: int = 20) -> DataFrame:
    """3-way join; the filter runs below both joins."""
    fp = t("fact_pulls").where(_ssr() & (F.col("pity_count") >= min_pity))
    p = t("stg_players").select(F.col("id").alias("_pid"), "username")
    c = t("dim_characters").select(F.col("character_id").alias("_cid"), F.col("name").alias("character_name"))
    return (
        fp.join(p, fp["player_id"] == p["_pid"])
        .join(c, fp["character_id"] == c["_cid"])
        .orderBy(F.desc("pity_count"), F.asc("pull_id"))
        .limit(n)
        .select("player_id", "username", "pity_count", "character_name")
    )


def fifty_fifty(t: Tables) -> DataFrame:
    """Label kept as in the dashboards (the flag means guaranteed or permanent)."""
    label = F.when(F.col("is_guaranteed"), FIFTY_FIFTY[True]).otherwise(FIFTY_FIFTY[False])
    return t("fact_pulls").where(_ssr()).groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("ssr_pulls"))


def whales(t: Tables, n: int = 20) -> DataFrame:
    """E11"""
    a = t("agg_player_spending")
    p = t("stg_players").select(F.col("id").alias("_pid"), "username", "region")
    return (
        a.join(p, a["player_id"] == p["_pid"])
        .orderBy(F.desc_nulls_last("total_usd_spent"), F.asc("player_id"))
        .limit(n)
        .select(
            "player_id",
            "username",
            "region",
            "total_pulls",
            "ssr_count",
            "total_crystals_spent",
            F.round("total_usd_spent", 2).alias("total_usd_spent"),
        )
    )


def spender_tiers(t: Tables) -> DataFrame:
    """E12"""
    s = F.col("total_usd_spent")
    (zero, free), *paid, (_, most) = TIERS
    tier = F.when(s == zero, free)
    for bound, label in paid:
        tier = tier.when(s < bound, label)
    tier = tier.otherwise(most)
    return (
        t("agg_player_spending")
        .groupBy(tier.alias("tier"))
        .agg(
            F.count(F.lit(1)).alias("players"),
            F.round(F.sum(s), 2).alias("total_revenue"),
            F.round(F.avg("total_pulls"), 0).alias("avg_pulls"),
        )
        .orderBy(_rank(F.col("tier"), [label for _, label in TIERS]).asc_nulls_last())
    )


def tx_status(t: Tables) -> DataFrame:
    """E13"""
    return (
        t("fact_transactions")
        .groupBy("payment_status")
        .agg(F.count(F.lit(1)).alias("transactions"), F.round(F.sum("amount_usd"), 2).alias("total_usd"))
        .orderBy(F.desc("transactions"))
    )


def packages(t: Tables) -> DataFrame:
    """E14"""
    return (
        t("fact_transactions")
        .where(F.col("payment_status") == "success")
        .groupBy("package_id")
        .agg(
            F.count(F.lit(1)).alias("purchases"),
            F.round(F.sum("amount_usd"), 2).alias("total_revenue"),
            F.round(F.avg("amount_usd"), 2).alias("avg_price"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"))
    )


def revenue_region(t: Tables) -> DataFrame:
    """Filter below the join; distinct payers per region."""
    tx = t("fact_transactions").where(F.col("payment_status") == "success")
    p = t("stg_players").select(F.col("id").alias("_pid"), "region")
    return (
        tx.join(p, tx["player_id"] == p["_pid"])
        .groupBy("region")
        .agg(
            F.count_distinct("player_id").alias("paying_players"),
            F.round(F.sum("amount_usd"), 2).alias("total_revenue"),
            F.round(F.avg("amount_usd"), 2).alias("avg_transaction"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"))
    )


def _char_join(t: Tables, ssr_only: bool = False) -> DataFrame:
    fp = t("fact_pulls").select("player_id", "character_id")
    c = t("dim_characters")
    if ssr_only:
        c = c.where(F.col("rarity") == "SSR")
    c = c.withColumnRenamed("character_id", "_cid")
    return fp.join(c, fp["character_id"] == c["_cid"])


def most_pulled(t: Tables) -> DataFrame:
    """E16"""
    return (
        _char_join(t)
        .groupBy(F.col("_cid").alias("character_id"), "name", "rarity", "archetype", "element")
        .agg(F.count(F.lit(1)).alias("times_pulled"), F.count_distinct("player_id").alias("unique_owners"))
        .orderBy(F.desc("times_pulled"))
    )


def ssr_characters(t: Tables) -> DataFrame:
    """The dimension filter is pushed below the join."""
    return (
        _char_join(t, ssr_only=True)
        .groupBy("name", "archetype", "element")
        .agg(F.count(F.lit(1)).alias("times_pulled"), F.count_distinct("player_id").alias("unique_owners"))
        .orderBy(F.desc("times_pulled"))
    )


def collection(t: Tables) -> DataFrame:
    """E18"""
    rng = _range_label(F.col("unique_characters"), COLLECTION)
    return (
        t("agg_player_spending")
        .groupBy(rng.alias("collection_range"))
        .agg(F.count(F.lit(1)).alias("players"))
        .orderBy(_rank(F.col("collection_range"), [label for _, label in COLLECTION]).asc_nulls_last())
    )


def banners(t: Tables) -> DataFrame:
    """E19"""
    fp = t("fact_pulls").select("banner_id", "player_id", "rarity")
    b = t("dim_banners").select(F.col("banner_id").alias("_bid"), "name", "type")
    return (
        fp.join(b, fp["banner_id"] == b["_bid"])
        .groupBy(F.col("_bid").alias("banner_id"), "name", "type")
        .agg(
            F.count(F.lit(1)).alias("total_pulls"),
            F.count_if(_ssr()).alias("ssr_pulls"),
            F.count_distinct("player_id").alias("players_pulled"),
            pct(F.count_if(_ssr()), F.count(F.lit(1))).alias("ssr_rate"),
        )
        .orderBy(F.desc("total_pulls"))
    )


ALL = {
    "overview": overview,
    "total_spent": total_spent,
    "rarity_dist": rarity_dist,
    "region_pulls": region_pulls,
    "payment_methods": payment_methods,
    "luckiest": luckiest,
    "unluckiest": unluckiest,
    "pity_histogram": pity_histogram,
    "high_pity_players": high_pity_players,
    "fifty_fifty": fifty_fifty,
    "whales": whales,
    "spender_tiers": spender_tiers,
    "tx_status": tx_status,
    "packages": packages,
    "revenue_region": revenue_region,
    "most_pulled": most_pulled,
    "ssr_characters": ssr_characters,
    "collection": collection,
    "banners": banners,
}

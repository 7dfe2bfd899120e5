"""Registered business-rule queries (G1-G16) over the built Gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cdcmart.operators import merge, rules
from cdcmart.plans.registry import register, wh

ORDER = ("pulled_at", "pull_id")
CUTOFF = "2024-01-15 00:00:00"
PLAYER_CUTOFF = "2023-01-01 12:00:00"
NOW = "2024-02-01 00:00:00"

# Pulls with their banner's type and rate-up, for the replays.
FP_TYPED = """
    (SELECT fp.*, b.type AS banner_type, b.rate_up_ssr_id
     FROM fact_pulls fp LEFT JOIN dim_banners b ON fp.banner_id = b.banner_id)"""


def _typed(w):
    return rules.with_banner_type(w.table("fact_pulls"), w.table("dim_banners"))


@register(
    "rule_pity_replay",
    f"""
    SELECT pull_id, player_id, banner_type, rarity, CAST(pos - coalesce(prev_ssr, 0) AS INTEGER) AS replayed_pity
    FROM (SELECT *, max(CASE WHEN rarity = 'SSR' THEN pos END) OVER (
                 PARTITION BY player_id, banner_type ORDER BY pulled_at, pull_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ssr
          FROM (SELECT *, row_number() OVER (PARTITION BY player_id, banner_type ORDER BY pulled_at, pull_id) AS pos
                FROM {FP_TYPED}))""",
)
def q_pity_replay(spark, sf_dir):
    """G1: pulls since the last SSR, counting this one, per (player, banner type)."""
    # Columns are chosen before the scan: its checkpoint is a pruning barrier.
    cols = ["pull_id", "player_id", "banner_type", "rarity", "pulled_at"]
    r = rules.pity_replay(_typed(wh(spark, sf_dir)).select(*cols), ORDER)
    return r.select("pull_id", "player_id", "banner_type", "rarity", "replayed_pity")


@register(
    "rule_pity_state",
    f"""
    SELECT player_id, banner_type,
           CAST(coalesce(min(rn) FILTER (WHERE rarity = 'SSR') - 1, count(*)) AS INTEGER) AS pity_count,
           max(pulled_at) AS updated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, banner_type ORDER BY pulled_at DESC, pull_id DESC) AS rn
          FROM {FP_TYPED})
    GROUP BY player_id, banner_type""",
)
def q_pity_state(spark, sf_dir):
    """Final pity per (player, banner type)."""
    return rules.pity_state(_typed(wh(spark, sf_dir)), ORDER)


@register(
    "rule_guarantee_replay",
    f"""
    SELECT pull_id, player_id, banner_type, rarity, is_guaranteed,
           coalesce(prev_lost, false) AS guaranteed_before,
           CASE WHEN rarity <> 'SSR' THEN false WHEN banner_type = 'permanent' THEN true
                ELSE coalesce(prev_lost, false) END AS expected_guaranteed
    FROM (SELECT *, last_value(lost IGNORE NULLS) OVER (
                 PARTITION BY player_id, banner_type ORDER BY pulled_at, pull_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_lost
          FROM (SELECT *, CASE WHEN rarity = 'SSR' AND banner_type = 'limited'
                               THEN coalesce(character_id <> rate_up_ssr_id, true) END AS lost
                FROM {FP_TYPED}))""",
)
def q_guarantee_replay(spark, sf_dir):
    """50/50 guarantee state before each pull and the flag it implies."""
    cols = ["pull_id", "player_id", "banner_type", "rarity", "is_guaranteed", "character_id", "rate_up_ssr_id",
            "pulled_at"]
    r = rules.guarantee_replay(_typed(wh(spark, sf_dir)).select(*cols), ORDER)
    return r.select(
        "pull_id", "player_id", "banner_type", "rarity", "is_guaranteed", "guaranteed_before", "expected_guaranteed"
    )


@register(
    "rule_hard_pity",
    f"""
    SELECT pull_id, player_id, banner_type, rarity, replayed_pity FROM (
      SELECT *, CAST(pos - coalesce(max(CASE WHEN rarity = 'SSR' THEN pos END) OVER (
                 PARTITION BY player_id, banner_type ORDER BY pulled_at, pull_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS replayed_pity
      FROM (SELECT *, row_number() OVER (PARTITION BY player_id, banner_type ORDER BY pulled_at, pull_id) AS pos
            FROM {FP_TYPED}))
    WHERE replayed_pity >= 90 AND rarity <> 'SSR'""",
)
def q_hard_pity(spark, sf_dir):
    """Pulls past hard pity that are not SSR (should be none)."""
    cols = ["pull_id", "player_id", "banner_type", "rarity", "pulled_at"]
    r = rules.pity_replay(_typed(wh(spark, sf_dir)).select(*cols), ORDER)
    return rules.hard_pity_violations(r).select("pull_id", "player_id", "banner_type", "rarity", "replayed_pity")


@register(
    "rule_ssr_rate",
    """
    SELECT pity_count, count(*) AS pulls, count(*) FILTER (WHERE rarity = 'SSR') AS ssr_pulls,
           round(count(*) FILTER (WHERE rarity = 'SSR') / count(*), 6) AS observed_rate,
           round(CAST(CASE WHEN pity_count >= 90 THEN 1.0 WHEN pity_count < 74 THEN 0.015
                      ELSE least(1.0, 0.015 + 0.06 * (pity_count - 74 + 1)) END AS DOUBLE), 6) AS expected_rate
    FROM fact_pulls GROUP BY pity_count""",
)
def q_ssr_rate(spark, sf_dir):
    """Observed vs configured SSR rate per pity counter."""
    return rules.ssr_rate_by_pity(wh(spark, sf_dir).table("fact_pulls"))


_SR_SQL = """
    SELECT p.id AS pull_id, p.batch_id, p.pull_number, b.has_sr_plus AS batch_has_sr_plus,
           (NOT b.has_sr_plus AND p.pull_number = b.last_number AND p.rarity = 'R') AS repaired,
           CASE WHEN NOT b.has_sr_plus AND p.pull_number = b.last_number AND p.rarity = 'R' THEN 'SR'
                ELSE p.rarity END AS rarity
    FROM stg_pulls p JOIN (SELECT batch_id, max(CASE WHEN rarity IN ('SR', 'SSR') THEN 1 ELSE 0 END) = 1 AS has_sr_plus,
                                  max(pull_number) AS last_number
                           FROM stg_pulls GROUP BY batch_id) b ON p.batch_id = b.batch_id
    UNION ALL SELECT id, NULL, pull_number, NULL, false, rarity FROM stg_pulls WHERE batch_id IS NULL"""


@register("rule_sr_repair", _SR_SQL)
def q_sr_repair(spark, sf_dir):
    """SR-or-better per batch; a batch of only R gets its last pull repaired."""
    r = rules.sr_guarantee(wh(spark, sf_dir).table("stg_pulls"), repair=True)
    return r.select(
        F.col("id").alias("pull_id"), "batch_id", "pull_number", "batch_has_sr_plus", "repaired", "rarity"
    )


@register(
    "rule_batch_integrity",
    """
    SELECT batch_id, count(*) AS pulls, min(pull_number) AS min_number, max(pull_number) AS max_number,
           count(DISTINCT pull_number) FILTER (pull_number BETWEEN 1 AND 10) AS numbers_seen,
           count(DISTINCT player_id) = 1 AS single_owner,
           (count(*) = 10 AND min(pull_number) = 1 AND max(pull_number) = 10
            AND count(DISTINCT pull_number) = 10 AND count(DISTINCT player_id) = 1) AS ok
    FROM stg_pulls WHERE batch_id IS NOT NULL GROUP BY batch_id""",
)
def q_batch_integrity(spark, sf_dir):
    """Batch size, numbering and single owner."""
    return rules.batch_integrity(wh(spark, sf_dir).table("stg_pulls"))


@register(
    "rule_inventory",
    """
    SELECT player_id, character_id, CAST(least(count(*) - 1, 6) AS INTEGER) AS constellation,
           min(pulled_at) AS obtained_at, max(pulled_at) AS updated_at
    FROM fact_pulls GROUP BY player_id, character_id""",
)
def q_inventory(spark, sf_dir):
    """Inventory from pulls."""
    return rules.build_inventory(wh(spark, sf_dir).table("fact_pulls"))


@register(
    "rule_upsert_increment",
    """
    SELECT player_id, character_id, CAST(least(count(*) - 1, 6) AS INTEGER) AS constellation,
           min(pulled_at) AS obtained_at, max(pulled_at) AS updated_at
    FROM fact_pulls GROUP BY player_id, character_id""",
)
def q_upsert_increment(spark, sf_dir):
    """Inventory of early pulls + capped increments from later pulls
    equals the inventory of all pulls."""
    fp = wh(spark, sf_dir).table("fact_pulls")
    cut = F.lit(CUTOFF).cast("timestamp")
    early = rules.build_inventory(fp.where(F.col("pulled_at") < cut))
    entries = fp.where(F.col("pulled_at") >= cut).select(
        "player_id", "character_id", F.lit(0).alias("constellation"), F.struct("pulled_at", "pull_id").alias("seq"),
        "pulled_at",
    )
    return merge.upsert_increment(early, entries, time="pulled_at")


@register(
    "rule_insert_if_absent",
    f"""
    SELECT id, CASE WHEN registered_at < TIMESTAMP '{PLAYER_CUTOFF}' THEN username ELSE upper(username) END AS username,
           region, crystal_balance, registered_at, updated_at
    FROM stg_players""",
)
def q_insert_if_absent(spark, sf_dir):
    """Insert players on conflict do nothing (existing rows keep their values)."""
    p = wh(spark, sf_dir).table("stg_players")
    target = p.where(F.col("registered_at") < F.lit(PLAYER_CUTOFF).cast("timestamp"))
    rows = p.withColumn("username", F.upper("username"))
    return merge.insert_if_absent(target, rows, ["id"])


@register(
    "rule_upsert_overwrite",
    f"""
    SELECT id, username, region,
           CASE WHEN registered_at >= TIMESTAMP '{PLAYER_CUTOFF}' THEN crystal_balance + 100 ELSE crystal_balance END
               AS crystal_balance,
           registered_at,
           CASE WHEN registered_at >= TIMESTAMP '{PLAYER_CUTOFF}' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
    FROM stg_players""",
)
def q_upsert_overwrite(spark, sf_dir):
    """Overwrite upsert stamping updated_at."""
    p = wh(spark, sf_dir).table("stg_players")
    rows = p.where(F.col("registered_at") >= F.lit(PLAYER_CUTOFF).cast("timestamp")).withColumn(
        "crystal_balance", F.col("crystal_balance") + 100
    )
    return merge.upsert_overwrite(p, rows, ["id"], now=F.lit(NOW).cast("timestamp"))


@register(
    "rule_first_buy",
    """
    SELECT transaction_id, player_id, package_id, is_first_buy,
           row_number() OVER w = 1 AS first_in_order,
           coalesce(max(CASE WHEN payment_status = 'success' THEN 1 ELSE 0 END) OVER (
               w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS no_earlier_success
    FROM fact_transactions
    WINDOW w AS (PARTITION BY player_id, package_id ORDER BY transacted_at, transaction_id)""",
)
def q_first_buy(spark, sf_dir):
    """First-buy flag, both definitions, next to the recorded flag."""
    t = wh(spark, sf_dir).table("fact_transactions").select(
        "transaction_id", "player_id", "package_id", "payment_status", "is_first_buy", "transacted_at"
    )
    b = rules.first_buy_flags(t)
    return b.select("transaction_id", "player_id", "package_id", "is_first_buy", "first_in_order", "no_earlier_success")


@register(
    "rule_crystals",
    """
    SELECT t.transaction_id, t.package_id, t.payment_status, t.is_first_buy,
           CAST(CASE WHEN t.payment_status IN ('failed', 'refunded') THEN 0
                     ELSE p.crystals + CASE WHEN t.is_first_buy THEN p.bonus ELSE 0 END END AS INTEGER)
               AS crystals_awarded
    FROM fact_transactions t LEFT JOIN (VALUES ('pkg-01', 60, 60), ('pkg-02', 300, 300), ('pkg-03', 980, 980),
        ('pkg-04', 1980, 1980), ('pkg-05', 3280, 3280), ('pkg-06', 90, 0)) AS p(pkg, crystals, bonus)
      ON t.package_id = p.pkg""",
)
def q_crystals(spark, sf_dir):
    """Crystals awarded per transaction."""
    t = wh(spark, sf_dir).table("fact_transactions")
    r = rules.crystals_awarded(t, rules.packages_df(spark))
    return r.select("transaction_id", "package_id", "payment_status", "is_first_buy", "crystals_awarded")


@register(
    "rule_ledger",
    """
    SELECT player_id, entry_id, kind, delta,
           CAST(sum(delta) OVER (PARTITION BY player_id ORDER BY entry_at, kind, entry_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance,
           sum(delta) OVER (PARTITION BY player_id ORDER BY entry_at, kind, entry_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0 AS overdrawn
    FROM (SELECT player_id, transacted_at AS entry_at, 0 AS kind, transaction_id AS entry_id,
                 CAST(crystals_added AS BIGINT) AS delta
          FROM fact_transactions WHERE payment_status = 'success'
          UNION ALL
          SELECT player_id, pulled_at, 1, pull_id, -CAST(crystals_spent AS BIGINT) FROM fact_pulls)""",
)
def q_ledger(spark, sf_dir):
    """Crystal ledger with running balance and overdraw flag."""
    w = wh(spark, sf_dir)
    r = rules.crystal_ledger(w.table("fact_transactions"), w.table("fact_pulls"))
    return r.select("player_id", "entry_id", "kind", "delta", "balance", "overdrawn")


_CAL_TX = """(SELECT t.*, p.region FROM fact_transactions t LEFT JOIN dim_players p ON t.player_id = p.player_id)"""


@register(
    "rule_rate_failure_by_method",
    """
    SELECT payment_method, count(*) AS transactions,
           round(avg(CASE WHEN payment_status = 'failed' THEN 1.0 ELSE 0.0 END), 6) AS observed_rate,
           CAST(CASE payment_method WHEN 'credit_card' THEN 0.05 WHEN 'google_pay' THEN 0.02
                WHEN 'apple_pay' THEN 0.015 ELSE 0.03 END AS DOUBLE) AS configured_rate
    FROM fact_transactions GROUP BY payment_method""",
)
def q_rate_failure(spark, sf_dir):
    """Failure rate by method, observed vs configured."""
    w = wh(spark, sf_dir)
    return rules.rate_calibration(w.table("fact_transactions"), w.table("dim_players"))["failure_by_method"]


@register(
    "rule_rate_refund_by_package",
    """
    SELECT package_id, count(*) AS transactions,
           round(avg(CASE WHEN payment_status = 'refunded' THEN 1.0 ELSE 0.0 END), 6) AS observed_rate,
           CAST(CASE package_id WHEN 'pkg-01' THEN 0.005 WHEN 'pkg-02' THEN 0.005 WHEN 'pkg-03' THEN 0.015
                WHEN 'pkg-04' THEN 0.015 WHEN 'pkg-05' THEN 0.03 WHEN 'pkg-06' THEN 0.03 ELSE 0.01 END AS DOUBLE)
               AS configured_rate
    FROM fact_transactions GROUP BY package_id""",
)
def q_rate_refund(spark, sf_dir):
    """Refund rate by package, observed vs configured."""
    w = wh(spark, sf_dir)
    return rules.rate_calibration(w.table("fact_transactions"), w.table("dim_players"))["refund_by_package"]


@register(
    "rule_rate_method_by_region",
    f"""
    SELECT region, payment_method, count(*) AS transactions,
           round(count(*) / sum(count(*)) OVER (PARTITION BY region), 6) AS share
    FROM {_CAL_TX} GROUP BY region, payment_method""",
)
def q_rate_method_region(spark, sf_dir):
    """Payment method share per region."""
    w = wh(spark, sf_dir)
    return rules.rate_calibration(w.table("fact_transactions"), w.table("dim_players"))["method_by_region"]


@register(
    "rule_rate_region_share",
    """
    SELECT region, count(*) AS players, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM dim_players GROUP BY region""",
)
def q_rate_region_share(spark, sf_dir):
    """Share of players per region."""
    w = wh(spark, sf_dir)
    return rules.rate_calibration(w.table("fact_transactions"), w.table("dim_players"))["region_share"]


@register(
    "rule_banner_window",
    """
    SELECT fp.pull_id, fp.banner_id,
           CASE WHEN b.start_date IS NULL OR b.end_date IS NULL THEN true
                ELSE CAST(fp.pulled_at AS DATE) BETWEEN b.start_date AND b.end_date END AS in_window
    FROM fact_pulls fp LEFT JOIN dim_banners b ON fp.banner_id = b.banner_id""",
)
def q_banner_window(spark, sf_dir):
    """Is each pull inside its banner's dates."""
    w = wh(spark, sf_dir)
    r = rules.banner_window_check(w.table("fact_pulls"), w.table("dim_banners"))
    return r.select("pull_id", "banner_id", "in_window")


@register(
    "rule_guarantee_state",
    f"""
    SELECT player_id, banner_type,
           coalesce(arg_max(coalesce(character_id <> rate_up_ssr_id, true), struct_pack(pulled_at, pull_id))
                    FILTER (WHERE rarity = 'SSR' AND banner_type = 'limited'), false) AS guaranteed_next
    FROM {FP_TYPED} GROUP BY player_id, banner_type""",
)
def q_guarantee_state(spark, sf_dir):
    """G3 final state: guaranteed_next per (player, banner type), an aggregate."""
    return rules.guarantee_state(_typed(wh(spark, sf_dir)), ORDER)

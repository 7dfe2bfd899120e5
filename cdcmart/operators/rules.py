"""Business-rule operators over pull and transaction tables.

The rules of the pull engine are replayed set-wise. Per-player running
values (pity counter, guarantee state, first buy, ledger) are segmented
scans over range partitions (operators/scan.py), so one player with a third
of all pulls is still split across tasks; ``method="window"`` keeps the
plain window form for small inputs. Final states are aggregates.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.schemas import PULL_CONFIG, MAX_CONSTELLATION, TOPUP_PACKAGES

_PRE = Window.unboundedPreceding


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def with_banner_type(pulls: DataFrame, banners: DataFrame) -> DataFrame:
    """Attach ``banner_type`` and ``rate_up_ssr_id`` of each pull's banner."""
    b = banners.select(
        F.col("banner_id").alias("_bid"),
        F.col("type").alias("banner_type"),
        F.col("rate_up_ssr_id"),
    )
    return pulls.join(b, pulls["banner_id"] == b["_bid"], "left").drop("_bid")


def pity_replay(
    pulls: DataFrame,
    order_cols=("pulled_at", "pull_id"),
    keys=("player_id", "banner_type"),
    rarity: str = "rarity",
    method: str = "scan",
) -> DataFrame:
    """G1: counter = pulls since the last SSR, counting this one.

    Counter = position in the key's sequence minus the position of the
    previous SSR (0 when none). ``scan`` (default) computes both with one
    segmented scan (operators/scan.py), so a hot player is split across
    tasks; ``window`` uses one plain window pass.
    """
    keys, order = list(keys), list(order_cols)
    if method == "scan":
        from cdcmart.operators.scan import segmented_scan

        specs = {"_pos": ("count", None, True), "_prev_ssr": ("lastpos", F.col(rarity) == "SSR", False)}
        out = segmented_scan(pulls, keys, order, specs)
        counter = F.col("_pos") - F.coalesce(F.col("_prev_ssr"), F.lit(0))
        return out.withColumn("replayed_pity", counter.cast("int")).drop("_pos", "_prev_ssr")
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    out = pulls.withColumn("_pos", F.row_number().over(w))
    prev_ssr = F.max(F.when(F.col(rarity) == "SSR", F.col("_pos"))).over(w.rowsBetween(_PRE, -1))
    return out.withColumn("replayed_pity", (F.col("_pos") - F.coalesce(prev_ssr, F.lit(0))).cast("int")).drop(
        "_pos"
    )


def pity_state(
    pulls: DataFrame,
    order_cols=("pulled_at", "pull_id"),
    keys=("player_id", "banner_type"),
    rarity: str = "rarity",
    time_col: str = "pulled_at",
) -> DataFrame:
    """Final pity counter per (player, banner type); 0 if the last pull is SSR.

    An aggregate, not a window: pulls after the last SSR are counted with a
    map-side partial aggregation, so a hot player is no problem.
    """
    order = F.struct(*_cols(order_cols))
    g = pulls.groupBy(*keys).agg(
        F.max(F.when(F.col(rarity) == "SSR", order)).alias("_last_ssr"),
        F.max(F.col(time_col)).alias("updated_at"),
    )
    # Count pulls strictly after the last SSR: second pass joined on the keys (nulls are keys).
    last = g.select(*[F.col(k).alias(f"_{k}") for k in keys], "_last_ssr")
    after = (
        pulls.join(last, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "inner")
        .where(F.col("_last_ssr").isNull() | (order > F.col("_last_ssr")))
        .groupBy(*[F.col(f"_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("pity_count"))
    )
    return (
        g.join(after, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
        .select(
            *keys,
            F.coalesce(F.col("pity_count"), F.lit(0)).cast("int").alias("pity_count"),
            "updated_at",
        )
    )


def guarantee_replay(
    pulls: DataFrame,
    order_cols=("pulled_at", "pull_id"),
    player: str = "player_id",
    method: str = "scan",
) -> DataFrame:
    """50/50 guarantee replay. Needs ``banner_type`` and ``rate_up_ssr_id``.

    guaranteed_before = the previous limited SSR of this player was not the
    rate-up of its banner. Permanent SSR -> flagged guaranteed; non-SSR false.
    The "previous limited SSR" is a last-non-null scan (skew-safe by default).
    """
    lim_ssr = (F.col("rarity") == "SSR") & (F.col("banner_type") == "limited")
    lost = F.when(lim_ssr, F.coalesce(F.col("character_id") != F.col("rate_up_ssr_id"), F.lit(True)))
    if method == "scan":
        from cdcmart.operators.scan import segmented_scan

        out = segmented_scan(pulls, [player, "banner_type"], list(order_cols), {"_prev_lost": ("last", lost, False)})
    else:
        w = Window.partitionBy(player, "banner_type").orderBy(*_cols(order_cols))
        out = pulls.withColumn("_prev_lost", F.last(lost, ignorenulls=True).over(w.rowsBetween(_PRE, -1)))
    guaranteed_before = F.coalesce(F.col("_prev_lost"), F.lit(False))
    expected = (
        F.when(F.col("rarity") != "SSR", F.lit(False))
        .when(F.col("banner_type") == "permanent", F.lit(True))
        .otherwise(guaranteed_before)
    )
    return (
        out.withColumn("guaranteed_before", guaranteed_before)
        .withColumn("expected_guaranteed", expected)
        .drop("_prev_lost")
    )


def guarantee_state(pulls: DataFrame, order_cols=("pulled_at", "pull_id"), player: str = "player_id") -> DataFrame:
    """Final guaranteed_next per (player, banner type) from the last limited SSR."""
    order = F.struct(*_cols(order_cols))
    lim_ssr = (F.col("rarity") == "SSR") & (F.col("banner_type") == "limited")
    lost = F.coalesce(F.col("character_id") != F.col("rate_up_ssr_id"), F.lit(True))
    return pulls.groupBy(player, "banner_type").agg(
        F.coalesce(F.max_by(F.when(lim_ssr, lost), F.when(lim_ssr, order)), F.lit(False)).alias("guaranteed_next")
    )


def hard_pity_violations(replayed: DataFrame, hard_pity: int = PULL_CONFIG["ssr_hard_pity"]) -> DataFrame:
    """Pulls at counter >= hard pity that are not SSR."""
    return replayed.where((F.col("replayed_pity") >= hard_pity) & (F.col("rarity") != "SSR"))


def expected_ssr_rate(n: Column, cfg=PULL_CONFIG) -> Column:
    """Configured SSR probability at pull number ``n`` since the last SSR."""
    base, start, step = cfg["ssr_base_rate"], cfg["ssr_soft_pity_start"], cfg["ssr_soft_pity_rate"]
    soft = F.least(F.lit(1.0), F.lit(base) + F.lit(step) * (n - start + 1))
    return (
        F.when(n >= cfg["ssr_hard_pity"], F.lit(1.0)).when(n < start, F.lit(base)).otherwise(soft).cast("double")
    )


def ssr_rate_by_pity(pulls: DataFrame, counter: str = "pity_count", cfg=PULL_CONFIG) -> DataFrame:
    """Observed vs configured SSR rate per pity counter value."""
    return (
        pulls.groupBy(counter)
        .agg(F.count(F.lit(1)).alias("pulls"), F.count_if(F.col("rarity") == "SSR").alias("ssr_pulls"))
        .select(
            F.col(counter).alias("pity_count"),
            "pulls",
            "ssr_pulls",
            F.round(F.col("ssr_pulls") / F.col("pulls"), 6).alias("observed_rate"),
            F.round(expected_ssr_rate(F.col(counter), cfg), 6).alias("expected_rate"),
        )
    )


def sr_guarantee(pulls: DataFrame, repair: bool = False, batch: str = "batch_id") -> DataFrame:
    """Every batch needs an SR or better; optionally repair the last pull.

    Batch-level values come from an aggregate joined back (batches are the
    grouping key, so no window over a possibly hot player). Single pulls have
    no batch: ``batch_has_sr_plus`` is null and they are never repaired.
    """
    sr_plus = F.col("rarity").isin("SR", "SSR")
    b = pulls.where(F.col(batch).isNotNull()).groupBy(batch).agg(
        F.max(sr_plus.cast("int")).alias("_has"), F.max("pull_number").alias("_last")
    )
    out = pulls.join(b, batch, "left").withColumn("batch_has_sr_plus", F.col("_has") == 1)
    if repair:
        fix = (~F.col("batch_has_sr_plus")) & (F.col("pull_number") == F.col("_last")) & (F.col("rarity") == "R")
        fix = F.coalesce(fix, F.lit(False))
        out = out.withColumn("repaired", fix).withColumn("rarity", F.when(fix, F.lit("SR")).otherwise(F.col("rarity")))
    return out.drop("_has", "_last")


def batch_integrity(pulls: DataFrame, batch: str = "batch_id", size: int = PULL_CONFIG["sr_guarantee_every"]) -> DataFrame:
    """Each batch has ``size`` pulls numbered 1..size from one player.
    Single pulls have no batch and are not judged.

    One partial aggregate: the numbers seen of 1..size are bits of a mask, and
    a batch has one owner when its least and greatest player agree.
    """
    n = F.col("pull_number")
    bit = F.when(n.between(1, size), F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))).otherwise(F.lit(0).cast("long"))
    owner = F.col("player_id")
    return (
        pulls.where(F.col(batch).isNotNull())
        .groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("pulls"),
            F.min(n).alias("min_number"),
            F.max(n).alias("max_number"),
            F.bit_count(F.bit_or(bit)).cast("long").alias("numbers_seen"),
            F.coalesce(F.min(owner) == F.max(owner), F.lit(False)).alias("single_owner"),
        )
        .withColumn(
            "ok",
            (F.col("pulls") == size)
            & (F.col("min_number") == 1)
            & (F.col("max_number") == size)
            & (F.col("numbers_seen") == size)
            & F.col("single_owner"),
        )
    )


def build_inventory(pulls: DataFrame, time_col: str = "pulled_at", cap: int = MAX_CONSTELLATION) -> DataFrame:
    """(player, character) -> constellation = min(copies - 1, cap)."""
    return pulls.groupBy("player_id", "character_id").agg(
        F.least(F.count(F.lit(1)) - 1, F.lit(cap)).cast("int").alias("constellation"),
        F.min(time_col).alias("obtained_at"),
        F.max(time_col).alias("updated_at"),
    )


def first_buy(
    transactions: DataFrame, order_cols=("transacted_at", "transaction_id"), mode: str = "first", method: str = "scan"
) -> DataFrame:
    """First-buy flag per (player, package).

    mode="first":   the first transaction in order (generation order).
    mode="success": no earlier *successful* transaction for the pair.
    """
    if mode not in ("first", "success"):
        raise ValueError("mode must be 'first' or 'success'")
    keys = ["player_id", "package_id"]
    ok = (F.col("payment_status") == "success").cast("int")
    if method == "scan":
        from cdcmart.operators.scan import segmented_scan

        spec = {"_s": ("count", None, False)} if mode == "first" else {"_s": ("max", ok, False)}
        out = segmented_scan(transactions, keys, list(order_cols), spec)
        flag = (F.col("_s") == 0) if mode == "first" else (F.coalesce(F.col("_s"), F.lit(0)) == 0)
        return out.withColumn("first_buy", flag).drop("_s")
    w = Window.partitionBy(*keys).orderBy(*_cols(order_cols))
    if mode == "first":
        flag = F.row_number().over(w) == 1
    else:
        flag = F.coalesce(F.max(ok).over(w.rowsBetween(_PRE, -1)), F.lit(0)) == 0
    return transactions.withColumn("first_buy", flag)


def first_buy_flags(transactions: DataFrame, order_cols=("transacted_at", "transaction_id")) -> DataFrame:
    """G12, both definitions from one segmented scan: ``first_in_order`` and
    ``no_earlier_success``."""
    from cdcmart.operators.scan import segmented_scan

    ok = (F.col("payment_status") == "success").cast("int")
    specs = {"_n": ("count", None, False), "_s": ("max", ok, False)}
    out = segmented_scan(transactions, ["player_id", "package_id"], list(order_cols), specs)
    return (
        out.withColumn("first_in_order", F.col("_n") == 0)
        .withColumn("no_earlier_success", F.coalesce(F.col("_s"), F.lit(0)) == 0)
        .drop("_n", "_s")
    )


def packages_df(spark):
    """The fixed top-up package table (6 rows; seed data)."""
    return spark.createDataFrame(
        TOPUP_PACKAGES,
        "package_id string, name string, crystals int, price_usd double, first_time_bonus int, "
        "daily_crystals int, duration_days int",
    )


def crystals_awarded(transactions: DataFrame, packages: DataFrame, first_col: str = "is_first_buy") -> DataFrame:
    """Base crystals + first-time bonus; 0 when failed or refunded.

    ``packages`` is the six-row seed table, so it is broadcast.
    """
    p = packages.select(
        F.col("package_id").alias("_pkg"), F.col("crystals").alias("_base"), F.col("first_time_bonus").alias("_bonus")
    )
    awarded = F.col("_base") + F.when(F.col(first_col), F.col("_bonus")).otherwise(F.lit(0))
    return (
        transactions.join(F.broadcast(p), transactions["package_id"] == p["_pkg"], "left")
        .withColumn(
            "crystals_awarded",
            F.when(F.col("payment_status").isin("failed", "refunded"), F.lit(0)).otherwise(awarded).cast("int"),
        )
        .drop("_pkg", "_base", "_bonus")
    )


def crystal_ledger(transactions: DataFrame, pulls: DataFrame) -> DataFrame:
    """Signed crystal movements per player with a running balance
    (a skew-safe running sum, operators/scan.py).

    Rows: +crystals_added for successful top-ups, -crystals_spent per pull.
    Order: time, credits before debits at the same instant, then entry id.
    """
    credits = transactions.where(F.col("payment_status") == "success").select(
        "player_id",
        F.col("transacted_at").alias("entry_at"),
        F.lit(0).alias("kind"),
        F.col("transaction_id").alias("entry_id"),
        F.col("crystals_added").cast("long").alias("delta"),
    )
    debits = pulls.select(
        "player_id",
        F.col("pulled_at").alias("entry_at"),
        F.lit(1).alias("kind"),
        F.col("pull_id").alias("entry_id"),
        (-F.col("crystals_spent")).cast("long").alias("delta"),
    )
    from cdcmart.operators.scan import segmented_scan

    moves = credits.unionByName(debits)
    out = segmented_scan(moves, ["player_id"], ["entry_at", "kind", "entry_id"], {"balance": ("sum", F.col("delta"), True)})
    return out.withColumn("overdrawn", F.col("balance") < 0)


def rate_calibration(transactions: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """Observed vs configured rates.

    failure rate by method, refund rate by package, method share by region,
    region share of players. Shares use a window over the small grouped
    result (one row per group), never over raw rows.
    """
    from cdcmart.schemas import (
        FAILED_RATE_BY_METHOD,
        FAILED_RATE_DEFAULT,
        REFUND_RATE_BY_PACKAGE,
        REFUND_RATE_DEFAULT,
    )

    def cfg_map(d):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])

    by_method = transactions.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.round(F.avg((F.col("payment_status") == "failed").cast("double")), 6).alias("observed_rate"),
    ).withColumn(
        "configured_rate",
        F.coalesce(F.element_at(cfg_map(FAILED_RATE_BY_METHOD), F.col("payment_method")), F.lit(FAILED_RATE_DEFAULT)),
    )
    by_package = transactions.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.round(F.avg((F.col("payment_status") == "refunded").cast("double")), 6).alias("observed_rate"),
    ).withColumn(
        "configured_rate",
        F.coalesce(F.element_at(cfg_map(REFUND_RATE_BY_PACKAGE), F.col("package_id")), F.lit(REFUND_RATE_DEFAULT)),
    )
    pl = players.select(F.col("player_id").alias("_pid"), "region")
    tx_region = transactions.join(pl, transactions["player_id"] == pl["_pid"], "left")
    g = tx_region.groupBy("region", "payment_method").agg(F.count(F.lit(1)).alias("transactions"))
    method_by_region = g.withColumn(
        "share", F.round(F.col("transactions") / F.sum("transactions").over(Window.partitionBy("region")), 6)
    )
    r = players.groupBy("region").agg(F.count(F.lit(1)).alias("players"))
    region_share = r.withColumn("share", F.round(F.col("players") / F.sum("players").over(Window.partitionBy()), 6))
    return {
        "failure_by_method": by_method,
        "refund_by_package": by_package,
        "method_by_region": method_by_region,
        "region_share": region_share,
    }


def banner_window_check(pulls: DataFrame, banners: DataFrame) -> DataFrame:
    """Pull time inside [start, end] of its banner; no dates = valid.

    Dates are whole days: a pull on the end date is inside.
    """
    b = banners.select(F.col("banner_id").alias("_bid"), "start_date", "end_date")
    day = F.to_date(F.col("pulled_at"))
    inside = (
        F.when(F.col("start_date").isNull() | F.col("end_date").isNull(), F.lit(True))
        .otherwise(day.between(F.col("start_date"), F.col("end_date")))
    )
    return pulls.join(b, pulls["banner_id"] == b["_bid"], "left").drop("_bid").withColumn("in_window", inside)

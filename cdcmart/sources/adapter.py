"""Driver tables -> the source system's tables and its CDC message stream.

The mapping is deterministic so that a SQL twin (plans/oracle.py) can state
the expected outcome of the whole pipeline from the same driver tables.

Mapping (see FIXTURES.md section 3):
  players        customer x nation x region; custkey % 7 = 3 moved to the next
                 region 30 days after registering, % 7 = 4 was updated then
                 without moving; % 14 in (3, 4) registered without a region;
                 % 41 = 40 has no username
  characters     part with partkey < 21: 0-4 SSR, 5-12 SR, 13-20 R
  banners        distinct events.event_type; 'view' permanent, others limited
  pulls          one per event; event_id % 23 = 11 by a guest who is no player,
                 % 97 = 13 of a character that is not listed, % 89 = 60 on
                 a banner that is not listed (no banner type), % 29 = 5 single
                 (no batch)
  transactions   one per order; some are of a status outside the accepted ones
  player_pity    rule replay of pulls (final pity and guarantee state)
  player_inventory  rule replay of pulls (copies -> constellation)
CDC faults on pull messages: update if event_id % 5 = 0, delete if % 17 = 0 (both
20 days late if % 20 = 0), create without ``op`` if % 101 = 0, truncated create
text if % 103 = 0, create delivered twice if % 59 = 7, one more message that
breaks one of the rules or names an unknown table if % 101 = 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.operators import rules
from cdcmart.schemas import PAYMENT_METHODS, TOPUP_PACKAGES
from cdcmart.sources.tables import load, load_spread

ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# Registration clock: 2023-01-01 00:00:00 UTC + custkey minutes.
REGISTERED_EPOCH_S = 1672531200
# Snapshot time for reference tables (2024-01-01 00:00:00 UTC), in ms.
SNAPSHOT_TS_MS = 1704067200000
# Limited banner window, in days since epoch: 2024-01-01 .. 2024-01-20.
LIMITED_START_DAY = 19723
LIMITED_END_DAY = 19742
# Delay of late updates and deletes; time from registration to a player's update.
LATE_MS = 20 * 86_400_000
MOVED_AFTER_S = 30 * 86_400
# Rate-up SSR per limited banner (event type).
RATE_UP = {"click": "ssr-001", "error": "ssr-002", "purchase": "ssr-003", "signup": "ssr-004"}


def _ts(c: Column) -> Column:
    return c.cast("timestamp")


def players(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Players as they are now; ``first_region`` is the one they registered in."""
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H tables.
    n = F.broadcast(nation.select("n_nationkey", "n_regionkey"))
    r = F.broadcast(region.select("r_regionkey", "r_name"))
    first = F.broadcast(region.select(F.col("r_regionkey").alias("_first"), F.col("r_name").alias("first_region")))
    k = F.col("c_custkey")
    reg = F.lit(REGISTERED_EPOCH_S) + k * 60
    upd = reg + F.when((k % 7).isin(3, 4), F.lit(MOVED_AFTER_S)).otherwise(F.lit(0))
    return (
        customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(first, F.col("n_regionkey") == F.col("_first"))
        .join(r, (F.col("n_regionkey") + (k % 7 == 3).cast("int")) % 5 == F.col("r_regionkey"))
        .select(
            k.cast("string").alias("id"),
            F.when(k % 41 != 40, F.col("c_name")).alias("username"),
            F.col("r_name").alias("region"),
            F.floor("c_acctbal").cast("int").alias("crystal_balance"),
            F.timestamp_seconds(reg).alias("registered_at"),
            F.timestamp_seconds(upd).alias("updated_at"),
            # some registered before they had a region
            F.when(~(k % 14).isin(3, 4), F.col("first_region")).alias("first_region"),
        )
    )


def characters(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    rarity = F.when(k < 5, "SSR").when(k < 13, "SR").otherwise("R")
    num = F.when(k < 5, k + 1).when(k < 13, k - 4).otherwise(k - 12)
    return part.where(k < 21).select(
        F.format_string("%s-%03d", F.lower(rarity), num.cast("int")).alias("id"),
        F.col("p_name").alias("name"),
        rarity.alias("rarity"),
        F.col("p_type").alias("archetype"),
        F.col("p_brand").alias("element"),
        F.lit(None).cast("string").alias("faction"),
        F.lit("1.0").alias("banner_debut"),
    )


def banners(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    limited = et != "view"
    rate_up = F.create_map(*[x for k, v in RATE_UP.items() for x in (F.lit(k), F.lit(v))])
    return (
        events.select("event_type")
        .distinct()
        .select(
            et.alias("id"),
            F.concat(F.lit("Banner "), et).alias("name"),
            F.when(limited, "limited").otherwise("permanent").alias("type"),
            F.lit("1.0").alias("version"),
            F.element_at(rate_up, et).alias("rate_up_ssr_id"),
            F.when(limited, F.lit(LIMITED_START_DAY)).alias("start_date"),
            F.when(limited, F.lit(LIMITED_END_DAY)).alias("end_date"),
        )
    )


def pulls(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    rarity = F.when(k < 2, "SSR").when(k < 12, "SR").otherwise("R")
    unlisted = eid % 97 == 13
    ssr_num = F.when(unlisted, F.lit(6)).otherwise(eid % 5 + 1)
    char_num = F.when(rarity == "SSR", ssr_num).otherwise(F.when(unlisted, F.lit(9)).otherwise(eid % 8 + 1))
    return events.select(
        eid.alias("event_id"),
        eid.cast("string").alias("id"),
        F.when(eid % 23 == 11, F.lit("guest")).otherwise(F.col("user_id").cast("string")).alias("player_id"),
        F.when(eid % 89 == 60, F.lit("retired")).otherwise(F.col("event_type")).alias("banner_id"),
        F.format_string("%s-%03d", F.lower(rarity), char_num.cast("int")).alias("character_id"),
        rarity.alias("rarity"),
        (eid % 90 + 1).cast("int").alias("pity_count"),
        ((rarity == "SSR") & (eid % 3 == 0)).alias("is_guaranteed"),
        (eid % 10 + 1).cast("int").alias("pull_number"),
        F.when(eid % 29 != 5, F.floor(eid / 10.0).cast("string")).alias("batch_id"),
        F.lit(160).alias("crystals_spent"),
        _ts(F.col("ts")).alias("pulled_at"),
    )


def transactions(orders: DataFrame) -> DataFrame:
    ok = F.col("o_orderkey")
    pkg = F.concat(F.lit("pkg-0"), F.substring("o_orderpriority", 1, 1))
    status = (
        F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(
            F.col("o_orderstatus") == "P",
            F.when(ok % 7 == 0, "chargeback").when(ok % 2 == 0, "failed").otherwise("refunded"),
        )
    )
    methods = F.array(*[F.lit(m) for m in PAYMENT_METHODS])
    crystals = F.create_map(*[x for p in TOPUP_PACKAGES for x in (F.lit(p[0]), F.lit(p[2]))])
    # First purchase of a package by a customer: an aggregate joined back
    # (partial aggregation; no per-customer sort).
    o = orders.withColumn("_pkg", pkg)
    firsts = o.groupBy("o_custkey", "_pkg").agg(F.min("o_orderkey").alias("_first"))
    first = F.col("o_orderkey") == F.col("_first")
    return (
        o.join(firsts, ["o_custkey", "_pkg"], "inner")
        .withColumn("_status", status)
        .select(
            ok.cast("string").alias("id"),
            F.col("o_custkey").cast("string").alias("player_id"),
            F.col("_pkg").alias("package_id"),
            F.when(F.col("_status") == "success", F.element_at(crystals, F.col("_pkg")))
            .otherwise(F.lit(0))
            .cast("int")
            .alias("crystals_added"),
            ((F.floor("o_totalprice") % 5000) / 100.0).cast("double").alias("amount_usd"),
            F.element_at(methods, (ok % 3 + 1).cast("int")).alias("payment_method"),
            F.col("_status").alias("payment_status"),
            first.alias("is_first_buy"),
            _ts(F.col("o_orderdate")).alias("transacted_at"),
        )
    )


def _pulls_with_type(pulls_df: DataFrame, banners_df: DataFrame) -> DataFrame:
    b = banners_df.select(F.col("id").alias("banner_id"), "type", "rate_up_ssr_id")
    p = pulls_df.select(
        F.col("id").alias("pull_id"), "event_id", "player_id", "banner_id", "character_id", "rarity", "pulled_at"
    )
    return rules.with_banner_type(p, b)


def player_pity(pulls_df: DataFrame, banners_df: DataFrame) -> DataFrame:
    p = _pulls_with_type(pulls_df, banners_df)
    order = ("pulled_at", "event_id")
    state = rules.pity_state(p, order_cols=order)
    guar = rules.guarantee_state(p, order_cols=order).withColumnsRenamed({"player_id": "_p", "banner_type": "_b"})
    same = F.col("player_id").eqNullSafe(F.col("_p")) & F.col("banner_type").eqNullSafe(F.col("_b"))
    return state.join(guar, same, "left").select(
        "player_id",
        "banner_type",
        "pity_count",
        F.coalesce("guaranteed_next", F.lit(False)).alias("guaranteed_next"),
        "updated_at",
    )


def player_inventory(pulls_df: DataFrame) -> DataFrame:
    return rules.build_inventory(pulls_df).select(
        "player_id", "character_id", "constellation", "obtained_at", "updated_at"
    )


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The source tables that are projections of the driver tables."""
    customer = load_spread(spark, sf_dir, "customer")
    return {
        "players": players(customer, load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")),
        "characters": characters(load(spark, sf_dir, "part")),
        "banners": banners(load(spark, sf_dir, "events")),
        "pulls": pulls(load_spread(spark, sf_dir, "events")),
        "transactions": transactions(load_spread(spark, sf_dir, "orders")),
    }


def replayed_tables(pulls_df: DataFrame, banners_df: DataFrame) -> dict[str, DataFrame]:
    """The source tables that the rules make from the pulls."""
    return {"player_pity": player_pity(pulls_df, banners_df), "player_inventory": player_inventory(pulls_df)}


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = base_tables(spark, sf_dir)
    return {**base, **replayed_tables(base["pulls"], base["banners"])}


# ---------------------------------------------------------------------------
# CDC messages
# ---------------------------------------------------------------------------


def _row_json(df: DataFrame, drop=("event_id", "first_region"), **instead: Column) -> Column:
    """The JSON text of a row, with the columns ``instead`` in place of its own."""
    cols = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = instead.get(f.name, F.col(f.name))
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, ISO_FMT)
        cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols))


def _envelope(table: Column | str, op: Column, before: Column, after: Column, ts_ms: Column,
              with_op: Column | None = None) -> Column:
    """Debezium-style envelope as text. ``with_op`` false drops the op key."""
    tbl = F.lit(table) if isinstance(table, str) else table
    op_part = F.concat(F.lit('"op":"'), op, F.lit('",'))
    if with_op is not None:
        op_part = F.when(with_op, op_part).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"payload":{"before":'),
        F.coalesce(before, F.lit("null")),
        F.lit(',"after":'),
        F.coalesce(after, F.lit("null")),
        F.lit(',"source":{"version":"2.5","connector":"postgresql","schema":"public","table":"'),
        tbl,
        F.lit('"},'),
        op_part,
        F.lit('"ts_ms":'),
        ts_ms.cast("string"),
        F.lit("}}"),
    )


def _simple_messages(df: DataFrame, table: str, op: str, ts_ms: Column) -> DataFrame:
    return df.select(
        _envelope(table, F.lit(op), F.lit(None).cast("string"), _row_json(df), ts_ms).alias("json")
    )


def player_messages(p: DataFrame) -> DataFrame:
    """A create in the first region; an update of those that changed since."""
    start = p.withColumn("region", F.col("first_region")).withColumn("updated_at", F.col("registered_at"))
    changed = p.where(F.col("updated_at") > F.col("registered_at"))
    updated = changed.select(
        _envelope("players", F.lit("u"), F.lit(None).cast("string"), _row_json(changed), F.unix_millis("updated_at")).alias("json")
    )
    return _simple_messages(start, "players", "c", F.unix_millis("updated_at")).unionByName(updated)


def _broken(row: Column) -> Column:
    """A message that breaks one validation rule, by turns each of them."""
    eid = F.col("event_id")
    source = '{"schema":"public","table":"pulls"}'
    kinds = [  # payload members: after, source, op, with a timestamp or not
        None,
        ("row", None, "c", True),
        ("row", source, "c", False),
        ("row", '"pulls"', "c", True),
        ("row", '{"schema":"public"}', "c", True),
        ("row", '{"table":"pulls"}', "c", True),
        ("row", source, "d", True),
        ("null", source, "c", True),
        ("{}", source, "r", True),
        ("row", '{"schema":"public","table":"audit_log"}', "c", True),
    ]
    ms = F.unix_millis("pulled_at").cast("string")
    kind = F.floor(eid / 101.0) % len(kinds)
    text = F.lit('{"payload":{}}')
    for i, made in enumerate(kinds):
        if made is None:
            continue
        after, src, op, stamped = made
        members = [F.lit('"before":null'), F.concat(F.lit('"after":'), row if after == "row" else F.lit(after))]
        members += [F.lit(f'"source":{src}')] if src else []
        members += [F.lit(f'"op":"{op}"')]
        members += [F.concat(F.lit('"ts_ms":'), ms)] if stamped else []
        text = F.when(kind == i, F.concat(F.lit('{"payload":{'), F.concat_ws(",", *members), F.lit("}}"))).otherwise(text)
    return text


def pull_messages(p: DataFrame) -> DataFrame:
    """Create, update and delete messages for pulls, with injected faults. All messages
    of a pull are made from one reading of it and one text of its row."""
    eid = F.col("event_id")
    none = F.lit(None).cast("string")
    changed = _row_json(p, crystals_spent=F.lit(320))
    texts = p.select("event_id", "pulled_at", _row_json(p).alias("_row"), F.when(eid % 5 == 0, changed).alias("_changed"))
    row, changed = F.col("_row"), F.col("_changed")
    ms = F.unix_millis("pulled_at")
    late = F.when(eid % 20 == 0, F.lit(LATE_MS)).otherwise(F.lit(0))
    # a delivery of a create is cut in half for some
    whole = texts.withColumn("_made", _envelope("pulls", F.lit("c"), none, row, ms, with_op=(eid % 101 != 0)))
    half = F.expr("substring(_made, 1, cast(length(_made) / 2 as int))")
    texts = whole.withColumn("_made", F.when(eid % 103 == 0, half).otherwise(F.col("_made")))
    messages = [
        (F.lit(True), F.col("_made")),
        (eid % 59 == 7, F.col("_made")),
        (eid % 5 == 0, _envelope("pulls", F.lit("u"), changed, changed, ms + 60000 + late)),
        (eid % 17 == 0, _envelope("pulls", F.lit("d"), row, none, ms + 120000 + late)),
        (eid % 101 == 50, _broken(row)),
    ]
    sent = [F.struct(when.alias("sent"), F.when(when, text).alias("json")) for when, text in messages]
    return texts.select(F.explode(F.array(*sent)).alias("_m")).where("_m.sent").select("_m.json")


def cdc_messages(src: dict[str, DataFrame]) -> DataFrame:
    """All source tables as one message stream: ``value`` (binary UTF-8)."""
    snap = F.lit(SNAPSHOT_TS_MS)
    parts = [
        _simple_messages(src["characters"], "characters", "r", snap),
        _simple_messages(src["banners"], "banners", "r", snap),
        player_messages(src["players"]),
        pull_messages(src["pulls"]),
        _simple_messages(src["transactions"], "transactions", "c", F.unix_millis("transacted_at")),
        _simple_messages(src["player_pity"], "player_pity", "c", F.unix_millis("updated_at")),
        _simple_messages(src["player_inventory"], "player_inventory", "c", F.unix_millis("updated_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.encode("json", "UTF-8").alias("value"))


#: Row groups of a written message log (bytes): a file is read in parts of this size at
#: least, so the one that holds most messages is not one task.
LOG_ROW_GROUP = 4 << 20


def write_messages(messages: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """The message log as files that split evenly when read."""
    messages.write.mode("overwrite").option("parquet.block.size", str(LOG_ROW_GROUP)).partitionBy(*partition_by).parquet(path)

"""Schemas, Silver table specs and fixed values.

Everything under "FIXED VALUES" must equal the source system's configuration
for results to line up; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (source-system configuration; keep as is)
# ---------------------------------------------------------------------------

# Debezium op code -> event name. Any other op is treated as an insert.
OP_EVENTS = {"c": "insert", "r": "insert", "u": "update", "d": "delete"}

# Top-level payload keys that must be present (presence, not truthiness).
REQUIRED_PAYLOAD_KEYS = ("op", "source", "ts_ms")

# CDC-captured tables (topup_packages is not captured).
CDC_TABLES = (
    "characters",
    "banners",
    "players",
    "pulls",
    "transactions",
    "player_pity",
    "player_inventory",
)

RARITIES = ("SSR", "SR", "R")
PAYMENT_STATUSES = ("success", "failed", "pending", "refunded")
PAYMENT_METHODS = ("credit_card", "google_pay", "apple_pay")
BANNER_TYPES = ("permanent", "limited")

# Top-up packages: id, name, crystals, price_usd, first_time_bonus,
# daily_crystals, duration_days.
TOPUP_PACKAGES = [
    ("pkg-01", "A Glance", 60, 0.99, 60, None, None),
    ("pkg-02", "A Whisper", 300, 4.99, 300, None, None),
    ("pkg-03", "A Promise", 980, 14.99, 980, None, None),
    ("pkg-04", "A Devotion", 1980, 29.99, 1980, None, None),
    ("pkg-05", "An Obsession", 3280, 49.99, 3280, None, None),
    ("pkg-06", "Monthly Pass", 90, 4.99, 0, 90, 30),
]

PULL_CONFIG = {
    "crystals_per_pull": 160,
    "crystals_per_10_pull": 1600,
    "ssr_base_rate": 0.015,
    "ssr_soft_pity_start": 74,
    "ssr_soft_pity_rate": 0.06,
    "ssr_hard_pity": 90,
    "sr_base_rate": 0.10,
    "sr_guarantee_every": 10,
    "r_base_rate": 0.885,
    "fifty_fifty_rate": 0.5,
}

# Refund rate by package and failure rate by payment method (configured rates).
REFUND_RATE_BY_PACKAGE = {
    "pkg-01": 0.005,
    "pkg-02": 0.005,
    "pkg-03": 0.015,
    "pkg-04": 0.015,
    "pkg-05": 0.030,
    "pkg-06": 0.030,
}
REFUND_RATE_DEFAULT = 0.010
FAILED_RATE_BY_METHOD = {"credit_card": 0.050, "google_pay": 0.020, "apple_pay": 0.015}
FAILED_RATE_DEFAULT = 0.030

# Inventory constellation cap.
MAX_CONSTELLATION = 6

# ---------------------------------------------------------------------------
# Bronze
# ---------------------------------------------------------------------------

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("event", T.StringType(), False),
        T.StructField("event_timestamp", T.TimestampType(), False),
        T.StructField("source_table", T.StringType(), False),
        T.StructField("source_schema", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)

DLQ_SCHEMA = T.StructType(
    [T.StructField("reason", T.StringType(), False), T.StructField("raw", T.StringType(), True)]
)


def bronze_schema() -> T.StructType:
    return BRONZE_SCHEMA


# ---------------------------------------------------------------------------
# Silver specs
# ---------------------------------------------------------------------------

# Column kinds understood by the Silver builder:
#   str    json text as is
#   int    cast to INT
#   double cast to DOUBLE
#   ts     cast ISO text to TIMESTAMP
#   bool   'true' -> true, anything else (incl. null/absent) -> false
#   days   days since epoch -> DATE


@dataclass(frozen=True)
class SilverSpec:
    table: str
    columns: list[tuple[str, str]]
    keys: list[str] = field(default_factory=lambda: ["id"])
    # Composite tables get a synthetic id = concat(keys, ':').
    synthetic_id: bool = False


SILVER_SPECS: dict[str, SilverSpec] = {
    "pulls": SilverSpec(
        "pulls",
        [
            ("id", "str"),
            ("player_id", "str"),
            ("banner_id", "str"),
            ("character_id", "str"),
            ("rarity", "str"),
            ("pity_count", "int"),
            ("is_guaranteed", "bool"),
            ("pull_number", "int"),
            ("batch_id", "str"),
            ("crystals_spent", "int"),
            ("pulled_at", "ts"),
        ],
    ),
    "transactions": SilverSpec(
        "transactions",
        [
            ("id", "str"),
            ("player_id", "str"),
            ("package_id", "str"),
            ("crystals_added", "int"),
            ("amount_usd", "double"),
            ("payment_method", "str"),
            ("payment_status", "str"),
            ("is_first_buy", "bool"),
            ("transacted_at", "ts"),
        ],
    ),
    "players": SilverSpec(
        "players",
        [
            ("id", "str"),
            ("username", "str"),
            ("region", "str"),
            ("crystal_balance", "int"),
            ("registered_at", "ts"),
            ("updated_at", "ts"),
        ],
    ),
    "player_pity": SilverSpec(
        "player_pity",
        [
            ("player_id", "str"),
            ("banner_type", "str"),
            ("pity_count", "int"),
            ("guaranteed_next", "bool"),
            ("updated_at", "ts"),
        ],
        keys=["player_id", "banner_type"],
        synthetic_id=True,
    ),
    "player_inventory": SilverSpec(
        "player_inventory",
        [
            ("player_id", "str"),
            ("character_id", "str"),
            ("constellation", "int"),
            ("obtained_at", "ts"),
            ("updated_at", "ts"),
        ],
        keys=["player_id", "character_id"],
        synthetic_id=True,
    ),
    "characters": SilverSpec(
        "characters",
        [
            ("id", "str"),
            ("name", "str"),
            ("rarity", "str"),
            ("archetype", "str"),
            ("element", "str"),
            ("faction", "str"),
            ("banner_debut", "str"),
        ],
    ),
    "banners": SilverSpec(
        "banners",
        [
            ("id", "str"),
            ("name", "str"),
            ("type", "str"),
            ("version", "str"),
            ("rate_up_ssr_id", "str"),
            ("start_date", "days"),
            ("end_date", "days"),
        ],
    ),
}

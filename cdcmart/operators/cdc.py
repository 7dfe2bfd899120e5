"""CDC dataflow operators (B1-B7). Pure df -> df; batch and streaming share them.

Every step is a narrow projection or filter, so the whole chain runs in one
stage with no shuffle. The message is parsed once into a VARIANT and all
checks read from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cdcmart.functions.columns import template, v_falsy, v_get, v_present, v_str
from cdcmart.schemas import OP_EVENTS, REQUIRED_PAYLOAD_KEYS

# ---------------------------------------------------------------------------
# FIXED VALUES: dead-letter reasons, in rule order ({name} = filled in)
# ---------------------------------------------------------------------------
REASONS = {
    "no_payload": "missing payload",
    "no_key": "missing payload.{key}",
    "source_not_object": "payload.source is not an object",
    "no_table": "missing payload.source.table",
    "no_schema": "missing payload.source.schema",
    "no_before": "delete event missing payload.before",
    "no_after": "op={op} missing payload.after",
}


#: Reason of the sinks that take known tables only.
UNKNOWN_TABLE = "unknown payload.source.table"


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """B1: UTF-8 decode + JSON parse; undecodable messages are dropped.

    Accepts a binary or string ``value``. Adds ``msg`` (VARIANT) and ``raw``.
    """
    vtype = dict(df.dtypes)[value]
    if vtype == "binary":
        ok = F.is_valid_utf8(F.col(value))
        text = F.col(value).cast("string")
    else:
        ok = F.lit(True)
        text = F.col(value)
    return (
        df.where(ok)
        .withColumn("raw", text)
        .withColumn("msg", F.try_parse_json("raw"))
        .where(F.col("msg").isNotNull())
    )


# Internal columns added by :func:`extract` (one navigation per field).
_FIELDS = ("_op", "_source", "_ts", "_tbl", "_sch", "_is_del", "_id", "_data_json")

_ZERO_JSON = r"^-?0+(\.0*)?([eE][+-]?[0-9]+)?$"


def _json_falsy(text: Column) -> Column:
    """Falsy test on a value's JSON text (null: absent)."""
    return text.isNull() | text.isin("null", "{}", "[]", '""', "false") | text.rlike(_ZERO_JSON)


def extract(df: DataFrame) -> DataFrame:
    """Navigate the parsed message once; later checks read these columns.

    Kept as separate projections so each generated function stays small and
    the expensive values (the row's JSON text) are computed once.
    """
    if "_data_json" in df.columns:
        return df
    m = F.col("msg")
    step1 = df.select(
        "*",
        v_get(m, "$.payload.op").alias("_op"),
        v_get(m, "$.payload.source").alias("_source"),
        v_get(m, "$.payload.ts_ms").alias("_ts"),
        v_present(m, "$.payload.source.table").alias("_tbl"),
        v_present(m, "$.payload.source.schema").alias("_sch"),
    )
    is_del = F.coalesce(v_str(F.col("_op"), "$") == "d", F.lit(False)) & (
        F.schema_of_variant(F.col("_op")) == "STRING"
    )
    step2 = step1.withColumn("_is_del", is_del).withColumn("_id", _of_row(lambda row: v_get(m, f"{row}.id")))
    return step2.withColumn("_data_json", _of_row(lambda row: _json_text(m, row)))


def _json_text(v: Column, path: str) -> Column:
    """The compact JSON text of a sub-value, keys sorted. An object is written as a map of its
    members, with one JSON writer for all its keys; VARIANT's own text makes a writer per
    key and string. Any other value is taken out first."""
    members = F.try_variant_get(v, path, "map<string,variant>")
    return F.coalesce(F.to_json(members), F.to_json(v_get(v, path)))


def _of_row(read: Callable[[str], Column]) -> Column:
    """``read`` at the path of the row that a message carries: before of a delete, else after."""
    return F.when(F.col("_is_del"), read("$.payload.before")).otherwise(read("$.payload.after"))


def _reason() -> Column:
    """B2: first failing rule, or null when the message is valid."""
    op_v, source = F.col("_op"), F.col("_source")
    any_key = op_v.isNotNull() | source.isNotNull() | F.col("_ts").isNotNull()
    # A payload with a known key is a non-empty object: it is not taken out and tested.
    payload_falsy = F.when(any_key, F.lit(False)).otherwise(v_falsy(v_get(F.col("msg"), "$.payload")))
    op_t = F.schema_of_variant(op_v)
    op = v_str(op_v, "$")
    op_repr = (
        F.when(op_t == "VOID", F.lit("None"))
        .when(op_t == "STRING", F.concat(F.lit("'"), op, F.lit("'")))
        .when(op_t == "BOOLEAN", F.when(op == "true", "True").otherwise("False"))
        .otherwise(F.to_json(op_v))
    )
    is_del = F.coalesce(F.col("_is_del"), F.lit(False))
    data_falsy = _json_falsy(F.col("_data_json"))
    # A truthy payload that is not an object has none of the keys; a root
    # that is not an object has no payload.
    chain = F.when(payload_falsy, F.lit(REASONS["no_payload"]))
    for key, c in zip(REQUIRED_PAYLOAD_KEYS, (op_v, source, F.col("_ts"))):
        chain = chain.when(c.isNull(), F.lit(REASONS["no_key"].format(key=key)))
    src_obj = F.col("_tbl") | F.col("_sch") | F.schema_of_variant(source).startswith("OBJECT")
    return (
        chain.when(~src_obj, F.lit(REASONS["source_not_object"]))
        .when(~F.col("_tbl"), F.lit(REASONS["no_table"]))
        .when(~F.col("_sch"), F.lit(REASONS["no_schema"]))
        .when(is_del & data_falsy, F.lit(REASONS["no_before"]))
        .when(~is_del & data_falsy, template(REASONS["no_after"], op=op_repr))
    )


def validate(df: DataFrame) -> DataFrame:
    """B2: add ``reason`` (null = valid). Needs ``msg`` from :func:`decode`."""
    return extract(df).withColumn("reason", _reason())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failures). Failures carry ``reason`` and ``raw`` JSON text."""
    valid = df.where(F.col("reason").isNull())
    failed = df.where(F.col("reason").isNotNull()).select("reason", F.to_json("msg").alias("raw"))
    return valid, failed


def row_key(data: Column) -> Column:
    """Text of ``data.id``; the text 'None' if present but null; a
    key-sorted compact JSON dump of the row when there is no ``id`` key."""
    idv = v_get(data, "$.id")
    return (
        F.when(idv.isNull(), F.to_json(data))
        .when(F.schema_of_variant(idv) == "VOID", F.lit("None"))
        .otherwise(v_str(data, "$.id"))
    )


def normalise(df: DataFrame) -> DataFrame:
    """Op -> event (unknown -> insert); data = before for deletes, else after.

    Output columns: id, data (JSON text), event, event_timestamp, source_table,
    source_schema.
    """
    df = extract(df)
    return df.select(*[c.alias(name) for name, c in _normal_cols()])


def segregate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes)."""
    return df.where(F.col("event").isin("insert", "update")), df.where(F.col("event") == "delete")


def by_table(df: DataFrame, table: str) -> DataFrame:
    """The changes of one source table (a partition filter on Bronze)."""
    return df.where(F.col("source_table") == table)


BRONZE_COLS = ("id", "data", "event", "event_timestamp", "source_table", "source_schema", "ingested_at")


def route(
    messages: DataFrame, value: str = "value", ingested_at: Column | None = None, stable_keys: dict | None = None,
    tables: Sequence[str] | None = None,
) -> DataFrame:
    """B1-B4 as ONE projection with a ``route`` column, no filter.

    route = 'bronze' (valid, normalised), 'dlq' (failed validation; carries
    ``reason`` and ``raw``) or 'undecodable' (bad UTF-8 or JSON; the
    source pipeline drops these; we keep them apart for audit). Writing the result
    partitioned by ``route`` lands every message once: a filter before the
    write would make Catalyst evaluate the parse and checks twice (the
    predicate is pushed below the projection and inlined).

    With ``tables``, valid messages of any other table are dead letters too,
    and only Bronze rows carry ``source_table``, so a sink partitioned by it
    never makes a folder of a name that a message invented.
    """
    vtype = dict(messages.dtypes)[value]
    if vtype == "binary":
        ok = F.is_valid_utf8(F.col(value))
        text = F.when(ok, F.col(value).cast("string"))
    else:
        text = F.col(value)
    d = messages.select(F.try_parse_json(text).alias("msg"))
    e = extract(d)
    reason = _reason()
    if tables is not None:
        known = F.coalesce(v_str(F.col("msg"), "$.payload.source.table").isin(*tables), F.lit(False))
        reason = F.coalesce(reason, F.when(~known, F.lit(UNKNOWN_TABLE)))
    stamp = ingested_at if ingested_at is not None else F.current_timestamp()
    norm = _normal_cols(stable_keys)
    r = F.when(F.col("msg").isNull(), F.lit("undecodable")).when(reason.isNull(), F.lit("bronze")).otherwise(F.lit("dlq"))
    out = e.select(
        r.alias("route"),
        *[c.alias(name) for name, c in norm],
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.to_json("msg")).alias("raw"),
    )
    if tables is not None:
        out = out.withColumn("source_table", F.when(F.col("route") == "bronze", F.col("source_table")))
    return out.withColumn("ingested_at", F.when(F.col("route") == "bronze", stamp))


#: Folders of the written log.
LOG_PARTITIONS = ("route", "source_table", "ingest_date")


def with_ingest_date(routed: DataFrame, grain: str = "day") -> DataFrame:
    """``ingest_date``: the first day of the ``grain`` (day, month, year) of the ingest
    time; null for what is not Bronze."""
    return routed.withColumn("ingest_date", F.to_date(F.date_trunc(grain, "ingested_at")))


def write_log(routed: DataFrame, path: str, grain: str = "day") -> None:
    """A3: the routed log as ``route/source_table/ingest_date`` folders, rows of a file
    sorted by key. A read of some tables and days opens their folders only, and a key
    filter skips row groups and pages by their statistics. The rebalance gives every
    folder files of an even size, however unequal the tables and days are."""
    clustered = with_ingest_date(routed, grain).hint("rebalance", *LOG_PARTITIONS).sortWithinPartitions(*LOG_PARTITIONS, "id")
    clustered.write.mode("overwrite").partitionBy(*LOG_PARTITIONS).parquet(path)


def log_slice(bronze: DataFrame, tables: Sequence[str], since: Column, until: Column, grain: str = "day", keys: Sequence[str] | None = None) -> DataFrame:
    """The Bronze rows of some tables ingested from ``since`` to before ``until``, of
    some keys or all: partition filters on table and date, pushed filters on time and key."""
    day = F.col("ingest_date")
    first, last = F.to_date(F.date_trunc(grain, since)), F.to_date(F.date_trunc(grain, until))
    rows = bronze.where(F.col("source_table").isin(*tables) & (day >= first) & (day <= last))
    rows = rows.where((F.col("ingested_at") >= since) & (F.col("ingested_at") < until))
    return rows.where(F.col("id").isin(*keys)) if keys is not None else rows


def _normal_cols(stable_keys: dict | None = None) -> list[tuple[str, Column]]:
    """Normalised columns. ``stable_keys`` ({table: [key fields]}) gives
    composite-key tables a Bronze id 'a:b' that does not change with every
    update (the default, as in the source, is the row's sorted JSON dump)."""
    m = F.col("msg")
    op = v_str(F.col("_op"), "$")
    op_map = F.create_map(*[x for k, v in OP_EVENTS.items() for x in (F.lit(k), F.lit(v))])
    idv = F.col("_id")
    table = v_str(m, "$.payload.source.table")
    dump = F.col("_data_json")
    for t, fields in (stable_keys or {}).items():
        parts = [_of_row(lambda row, f=f: v_str(m, f"{row}.{f}")) for f in fields]
        key = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(":")] if i else []) + [p]])
        # a row with a null half has no composite key and keeps its dump
        dump = F.when((table == t) & key.isNotNull(), key).otherwise(dump)
    key = (
        F.when(idv.isNull(), dump)
        .when(F.schema_of_variant(idv) == "VOID", F.lit("None"))
        .otherwise(v_str(idv, "$"))
    )
    return [
        ("id", key),
        ("data", F.col("_data_json")),
        ("event", F.coalesce(F.element_at(op_map, op), F.lit("insert"))),
        ("event_timestamp", F.timestamp_millis(F.try_variant_get(F.col("_ts"), "$", "bigint"))),
        ("source_table", v_str(m, "$.payload.source.table")),
        ("source_schema", v_str(m, "$.payload.source.schema")),
    ]


def to_bronze(messages: DataFrame, ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(bronze rows, dead letters) as two lazy views of :func:`route`.

    For writing both, prefer ``route()`` + one partitioned write (one pass).
    ``ingested_at`` defaults to the processing time; batch replays pass a
    deterministic column (e.g. ``event_timestamp``) instead.
    """
    r = route(messages, ingested_at=ingested_at)
    bronze = r.where(F.col("route") == "bronze").select(*BRONZE_COLS)
    dlq = r.where(F.col("route") == "dlq").select("reason", "raw")
    return bronze, dlq

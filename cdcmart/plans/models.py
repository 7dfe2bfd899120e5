"""The medallion build: source tables -> CDC -> Bronze -> Silver -> Gold.

``layers()`` declares every table lazily. ``run_models()`` materialises them
in dependency order (A6): Bronze is written partitioned by ``source_table``
and read back, so Silver scans prune to one table's partition and lineage is
cut at each layer (a lost executor recomputes from the last written layer,
not from the raw messages).
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.operators import cdc, gold, silver
from cdcmart.schemas import SILVER_SPECS
from cdcmart.session import path_exists, work_dir
from cdcmart.sources import adapter
from cdcmart.sources.tables import fingerprint, spread

# Topological order of the models.
SILVER_MODELS = [
    "stg_pulls",
    "stg_transactions",
    "stg_players",
    "stg_player_pity",
    "stg_player_inventory",
    "stg_characters",
    "stg_banners",
]
GOLD_MODELS = [
    "fact_pulls",
    "fact_transactions",
    "dim_players",
    "dim_characters",
    "dim_banners",
    "agg_player_spending",
]
MODEL_ORDER = ["bronze", "dlq", *SILVER_MODELS, *GOLD_MODELS]

def _code_version() -> str:
    """Hash of the modules that shape the built tables: a code change
    invalidates earlier builds in the shared folder."""
    import cdcmart

    base = os.path.dirname(cdcmart.__file__)
    h = hashlib.sha1()
    for rel in ("schemas.py", "sources/adapter.py", "sources/tables.py", "operators/cdc.py", "operators/silver.py",
                "operators/gold.py", "operators/rules.py", "functions/columns.py", "plans/models.py"):
        with open(os.path.join(base, rel), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:12]


BUILD_VERSION = _code_version()


def gold_from(t) -> dict[str, DataFrame]:
    """Gold models from a Silver accessor."""
    fp = gold.fact_pulls(t("stg_pulls"), t("stg_players"))
    ft = gold.fact_transactions(t("stg_transactions"))
    return {
        "fact_pulls": fp,
        "fact_transactions": ft,
        "dim_players": gold.dim_players(t("stg_players")),
        "dim_characters": gold.dim_characters(t("stg_characters")),
        "dim_banners": gold.dim_banners(t("stg_banners")),
        "agg_player_spending": gold.agg_player_spending(fp, ft),
    }


def layers(spark: SparkSession, sf_dir: str, honor_deletes: bool = False) -> dict[str, DataFrame]:
    """All tables as one lazy plan (no writes)."""
    src = adapter.source_tables(spark, sf_dir)
    msgs = adapter.cdc_messages(src)
    bronze, dlq = cdc.to_bronze(msgs, ingested_at=F.col("event_timestamp"))
    out: dict[str, DataFrame] = {"bronze": bronze, "dlq": dlq}
    out.update(silver.build_all(bronze, honor_deletes))
    out.update(gold_from(lambda n: out[n]))
    return out


class Warehouse:
    """Materialised layers under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def source(self, name: str) -> DataFrame:
        """A table of the source system, as it was when the build read it."""
        return self.spark.read.parquet(self.path(f"source/{name}"))

    def log(self) -> DataFrame:
        """The Bronze log with its ``ingest_date`` folders."""
        path = self.path("cdc/route=bronze")
        return self.spark.read.option("basePath", path).parquet(path)

    def table(self, name: str) -> DataFrame:
        if name == "bronze":
            return self.log().select(*cdc.BRONZE_COLS)
        if name == "dlq":
            path = self.path("cdc/route=dlq")
            if not path_exists(self.spark, path):  # a clean log rejects nothing
                return self.spark.createDataFrame([], "reason string, raw string")
            return self.spark.read.parquet(path).select("reason", "raw")
        return self.spark.read.parquet(self.path(name))

    __call__ = table

    def register_views(self, prefix: str = "") -> list[str]:
        """Every model as a temp view (``prefix + name``), so dashboard SQL
        runs unchanged through ``spark.sql``."""
        names = [*MODEL_ORDER]
        for n in names:
            self.table(n).createOrReplaceTempView(prefix + n)
        return [prefix + n for n in names]

    def complete(self) -> bool:
        """True when the build marker (written last) is readable. Uses Spark's
        file system layer, so it works for any shared-folder scheme."""
        if not path_exists(self.spark, self.path("_build_ok")):
            return False
        row = self.spark.read.text(self.path("_build_ok")).first()
        return row is not None and row[0] == BUILD_VERSION

    def mark_complete(self) -> None:
        self.spark.createDataFrame([(BUILD_VERSION,)], "v string").coalesce(1).write.mode("overwrite").text(
            self.path("_build_ok")
        )


#: Models built at once (jobs of independent tables share the cluster).
THREADS = 4


def in_parallel(tasks: Sequence[Callable[[], object]], threads: int = THREADS) -> None:
    """Run independent jobs from a few driver threads; the first failure is raised
    after all have ended."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for done in [pool.submit(t) for t in tasks]:
            done.result()


def run_models(
    spark: SparkSession, sf_dir: str, root: str, honor_deletes: bool = False, targets=None
) -> Warehouse:
    """Full refresh of every model, layer by layer."""
    wh = Warehouse(spark, root)

    def write(name: str, rows: DataFrame) -> Callable[[], object]:
        return lambda: rows.write.mode("overwrite").parquet(wh.path(name))

    def write_source(tables: dict[str, DataFrame]) -> None:
        in_parallel([write(f"source/{n}", rows) for n, rows in tables.items()])

    # The source tables are made once; messages and reconciliation read them. Messages are
    # made by as many tasks as the rows need, so no task sorts more of the log than it holds.
    base = adapter.base_tables(spark, sf_dir)
    write_source(base)
    replayed = adapter.replayed_tables(wh.source("pulls"), wh.source("banners"))
    write_source(replayed)
    msgs = adapter.cdc_messages({n: spread(wh.source(n), wh.path(f"source/{n}")) for n in [*base, *replayed]})
    routed = cdc.route(msgs, ingested_at=F.col("event_timestamp"), tables=list(SILVER_SPECS))
    # One pass over the messages: Bronze (by table), dead letters and
    # undecodable messages land in sibling folders of one write.
    cdc.write_log(routed, wh.path("cdc"), grain="month")  # ingest time is event time here: years of it
    b = wh.table("bronze")
    stg = silver.build_all(b, honor_deletes)
    in_parallel([write(n, stg[n]) for n in SILVER_MODELS if targets is None or n in targets])
    g = gold_from(wh.table)
    in_parallel([write(n, g[n]) for n in GOLD_MODELS if targets is None or n in targets])
    if targets is None:
        wh.mark_complete()
    return wh


_LOCK = threading.Lock()
_BUILT: dict[tuple, str] = {}  # (data, its fingerprint, options, shared folder) -> built root


def warehouse(spark: SparkSession, sf_dir: str, honor_deletes: bool = False, fresh: bool = False) -> Warehouse:
    """The built warehouse for ``sf_dir`` in this session's shared folder.

    Built once per application and (folder, fingerprint of its files, options); later
    calls read the written tables. Every build goes to a folder of its own.
    ``fresh`` forces a new build.
    """
    real, files = os.path.realpath(sf_dir), fingerprint(spark, sf_dir)
    key = (real, files, honor_deletes, work_dir(spark))
    with _LOCK:
        root = _BUILT.get(key)
        if root is not None and not fresh:  # verified or built by this process
            return Warehouse(spark, root)  # bound to the caller's session
        wh = run_models(spark, sf_dir, f"{work_dir(spark)}/cdcmart-wh-{uuid.uuid4().hex[:10]}", honor_deletes)
        _BUILT[key] = wh.root
        return wh

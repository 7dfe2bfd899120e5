"""Session and shared-folder helpers.

Cluster settings always win: a setting is only filled in when the session
does not have it yet (as in local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings we want on every session; applied only where the session has none.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("cdcmart")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # checkpoint files of scans are removed once their data is no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in defaults that the session does not set itself."""
    for k, v in _DEFAULTS.items():
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static or locked conf: keep the cluster's value
            pass
    # UTC is required for the epoch-ms and ISO text round trips to be exact.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    work_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cdcmart`` importable in the Python workers (pandas UDFs and the
    stateful watchlist run there): zip the package once per application and
    add it with ``addPyFile``, as ``--py-files`` would on a cluster."""
    try:
        sc = spark.sparkContext
    except Exception:
        return
    if sc.applicationId in _SHIPPED:
        return
    import cdcmart

    pkg = os.path.dirname(os.path.abspath(cdcmart.__file__))
    base = work_dir(spark)
    folder = base if "://" not in base or base.startswith("file:") else tempfile.mkdtemp(prefix="cdcmart-py-")
    folder = folder.replace("file://", "", 1).replace("file:", "", 1)
    target = os.path.join(folder, f"cdcmart-py-{sc.applicationId}.zip")
    import zipfile

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


_FALLBACK: dict[str, str] = {}  # application id -> folder chosen when none is configured


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir``; only when the session has none (local
    tests) is a fresh folder under the system temp dir chosen (once per
    application) and used as the context's checkpoint folder. The setting
    itself is a core config and cannot be changed on a running session.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local context
        sc = None
    path = (sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not path:
        app = sc.applicationId if sc is not None else "remote"
        path = _FALLBACK.get(app)
        master = sc.getConf().get("spark.master", "local") if sc is not None else "local"
        if path is None and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if path is None:
            path = _FALLBACK[app] = tempfile.mkdtemp(prefix="cdcmart-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of its file system; I/O errors propagate,
    so a failed read is never taken for an absent table."""
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the file, or of all files of the folder, at ``path``."""
    target, fs = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def range_partitions(df: DataFrame, target_bytes: int = 128 << 20) -> int:
    """Partitions of a range shuffle that must keep its layout (AQE cannot split
    it): the session's shuffle partitions, more where the folders that ``df``
    reads hold more than ``target_bytes`` for each of them."""
    spark = df.sparkSession
    size = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        size += stored_bytes(spark, folder)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target_bytes))

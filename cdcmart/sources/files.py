"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A5: a seed document {characters[], banners[], topup_packages[], gacha_config{}}
    as tables. ``rate_up_ssr`` becomes ``rate_up_ssr_id``; ``visual.portrait``
    is flattened to ``portrait``; the config becomes one (key, value) row each.
    The document is read with ``multiLine`` and exploded on the executors."""
    doc = spark.read.option("multiLine", "true").json(path)
    out: dict[str, DataFrame] = {}
    cols = set(doc.columns)
    if "characters" in cols:
        ch = doc.select(F.inline("characters"))
        if "visual" in ch.columns:
            ch = ch.withColumn("portrait", F.col("visual.portrait")).drop("visual")
        out["characters"] = ch
    if "banners" in cols:
        b = doc.select(F.inline("banners"))
        if "rate_up_ssr" in b.columns:
            b = b.withColumnRenamed("rate_up_ssr", "rate_up_ssr_id")
        out["banners"] = b
    if "topup_packages" in cols:
        out["topup_packages"] = doc.select(F.inline("topup_packages"))
    if "gacha_config" in cols:
        cfg = doc.select("gacha_config.*")
        out["gacha_config"] = cfg.select(
            F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cfg.columns]),
                                        F.array(*[F.col(c).cast("double") for c in cfg.columns]))).alias("key", "value")
        )
    return out


def read_table(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    """CSV (header, explicit schema when given), parquet or JSON by suffix.
    XLSX is not read (convert to CSV first)."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt in ("xlsx", "xls"):
        raise ValueError("XLSX is not supported; convert to CSV")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", "true").option("inferSchema", "false" if schema else "true").csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; one file per task (no single-writer funnel)."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def query(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """Run parameterised SQL over named DataFrames; the result stays lazy."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def write_dlq_json(dead_letters: DataFrame, path: str) -> None:
    """A4: dead letters as JSON lines ``{"reason": ..., "raw": ...}``.
    Pass materialised rows (e.g. the written ``route=dlq`` folder)."""
    dead_letters.select(F.to_json(F.struct("reason", "raw")).alias("value")).write.mode("overwrite").text(path)

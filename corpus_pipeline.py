"""Corpus pipeline: documents in, token ids out.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept and calls one operator of ``cdcmart.llm``; :func:`run` writes each result
as Parquet in the shared folder and reads it back as the next stage's input.
All stages but the last return the columns of ``documents``. The order of the mix
stands in the order of the written rows; the last stage reads it off the files and
returns it as ``position``.

Nulls in any column, empty and very long texts, repeated rows and empty tables
pass through every stage with the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cdcmart.llm import bpe, exact_dedup, mixing, simhash, toxicity
from cdcmart.llm.common import materialize
from cdcmart.llm.queries import MIX_WEIGHTS
from cdcmart.session import configure
from cdcmart.sources.tables import load


#: Offsets of up to this many part files are broadcast (about 20 MB).
BROADCAST_FILES = 100_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The model is trained on the
    labelled part of the documents at hand."""
    configure(spark)
    model = toxicity.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = "_toxicity"
    while out in docs.columns:
        out += "_"
    scored = toxicity.score(docs, model, out=out)
    return scored.where(F.col(out) < 0.5).drop(out)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest doc_id, of each group of equal texts."""
    configure(spark)
    return exact_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each SimHash component."""
    configure(spark)
    return simhash.first_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    configure(spark)
    return mixing.mixed_rows(docs, MIX_WEIGHTS)


def file_positions(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of its columns, so no name can clash)
    with ``position``: its place, gapless from 0, in the order of Spark's part files and
    of the rows within. How files are packed into tasks does not matter, and rows may
    have been filtered out since they were read. A table that comes from no files is
    written first."""
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    try:
        rows = docs.select(row, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return file_positions(materialize(docs, "ordered"))
    part = r"/part-(\d+)[^/]*?(?:-c(\d+))?(?:\.[^/]*)?$"
    numbers = [F.regexp_extract("path", part, i).try_cast("bigint") for i in (1, 2)]
    files = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    if not files.where("n <> last + 1").isEmpty():  # rows are missing: number those that are left
        inside = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1  # one file at a time
        rows = rows.withColumn("at", inside)
    before = Window.orderBy(*numbers, "path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    begins = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    if len(docs.inputFiles()) <= BROADCAST_FILES:  # one row per file
        begins = F.broadcast(begins)
    return rows.join(begins, "path").select("row", (F.col("begin") + F.col("at")).alias("position"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, its ``position`` in the mix, and whether the
    ids decode to its text."""
    configure(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    row = {c: F.col(f"row.c{docs.columns.index(c)}") for c in ("doc_id", "lang", "source", "text")}
    marked = file_positions(docs).select(
        *[row[c].alias(c) for c in ("doc_id", "lang", "source")], "position", row["text"].alias("text"),
        F.sha2(F.coalesce(row["text"], F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
    read = bpe.decode(bpe.encode(marked, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return read.select(
        "doc_id", "lang", "source", "position", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("bytes", 256) == F.col("text_sha256")).alias("round_trip")
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after another."""
    configure(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SimHash, the classifier and BPE cannot be stated in SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None

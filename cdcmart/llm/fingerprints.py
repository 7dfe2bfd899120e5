"""Document fingerprints by a homomorphic multiset hash, with DataFrame
operations only.

A paragraph (line) is hashed to a wide vector, and a document's fingerprint is
the sum of the vectors of its paragraphs. The sum does not depend on their order,
and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`). The vector has two parts:

* ``EXACT`` = 8 lanes, uniform modulo 2**32, hashed from the whole paragraph:
  equal fingerprints mean equal multisets of paragraphs;
* ``SIGNS`` = 256 lanes, the sum modulo 2**16 of +1 or -1 per sentence of the
  paragraph: the inner product of two such sums estimates the inner product of
  the documents' multisets of sentences (a tug-of-war sketch), with a standard
  error near 1/16 of the norm.

The likeness of two fingerprints is ``2 <a, b> / (<a, a> + <b, b>)`` over the sign
lanes, from 0 to 1; 1 for equal fingerprints. Lanes are summed two to a long
(fields of 32 bits), so a document has room for 2**31 paragraphs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_HASHES = 4
SIGN_HASHES = 4
ROWS_PER_RANGE = 500
MAX_RANGES = 1 << 16
_PAIR = (1 << 32) + 1
_LOW = (1 << 32) - 1


def _pieces(text: Column, which: int) -> Column:
    """Structs ``(which, kind, piece)``: paragraphs (kind 0) and sentences (1)."""
    def tagged(kind: int, pattern: str) -> Column:
        return F.transform(F.split(text, pattern), lambda p: F.struct(F.lit(which).alias("which"), F.lit(kind).alias("kind"), p.alias("piece")))

    return F.concat(tagged(0, "\n"), tagged(1, "\n|(?<=[.!?]) +"))


def _lane_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the vectors of ``(kind, piece)`` rows by ``keys``: ``exact`` (array of
    long) and ``signs`` (array of int, in -2**15 to 2**15 - 1)."""
    exact = [F.when(F.col("kind") == 0, F.xxhash64(F.lit(k), "piece")).otherwise(0).alias(f"e{k}") for k in range(EXACT_HASHES)]
    signs = [F.when(F.col("kind") == 1, F.xxhash64(F.lit(100 + k), "piece")).otherwise(0).alias(f"s{k}") for k in range(SIGN_HASHES)]
    hashed = rows.select(*keys, F.col("kind").cast("long").alias("kind"), *exact, *signs)
    sums = [F.sum(F.col(f"e{k}").bitwiseAND(_LOW) if half == 0 else F.shiftrightunsigned(f"e{k}", 32)).alias(f"x{k}_{half}") for k in range(EXACT_HASHES) for half in (0, 1)]
    sums += [F.sum(F.shiftrightunsigned(f"s{k}", j).bitwiseAND(_PAIR)).alias(f"y{k}_{j}") for k in range(SIGN_HASHES) for j in range(32)]
    made = hashed.groupBy(*keys).agg(F.sum("kind").alias("n"), *sums)
    counts = [c for k in range(SIGN_HASHES) for j in range(32) for c in (F.col(f"y{k}_{j}").bitwiseAND(_LOW), F.shiftrightunsigned(f"y{k}_{j}", 32))]
    wrapped = [((2 * c - F.col("n") + (1 << 15)).bitwiseAND(0xFFFF) - (1 << 15)).cast("int") for c in counts]
    return made.select(
        *keys, F.array(*[F.col(f"x{k}_{half}").bitwiseAND(_LOW) for k in range(EXACT_HASHES) for half in (0, 1)]).alias("exact"), F.array(*wrapped).alias("signs")
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together (``sign`` 1), or of ``a``
    without ``b`` (-1). Columns are structs ``(exact, signs)``."""
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: (x + sign * y).bitwiseAND(_LOW)).alias("exact"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: ((x + sign * y + (1 << 15)).bitwiseAND(0xFFFF) - (1 << 15)).cast("int")).alias("signs"),
    )


def digest(print_: Column) -> Column:
    """A fingerprint as lowercase hex: exact lanes of 8 digits, sign lanes of 4."""
    exact = F.array_join(F.transform(print_["exact"], lambda x: F.lpad(F.hex(x), 8, "0")), "")
    signs = F.array_join(F.transform(print_["signs"], lambda x: F.lpad(F.hex(x.bitwiseAND(0xFFFF)), 4, "0")), "")
    return F.lower(F.concat(exact, signs))


def likeness(a: Column, b: Column) -> Column:
    """From 0 (nothing shared) to 1 (equal)."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norms = dot(a["signs"], a["signs"]) + dot(b["signs"], b["signs"])
    shared = F.when(norms > 0, 2 * dot(a["signs"], b["signs"]) / norms).otherwise(0.0)
    return F.when((a["exact"] == b["exact"]) & (a["signs"] == b["signs"]), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``print``, a struct of ``exact`` and
    ``signs``. Null counts as the empty text, which is one empty paragraph."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), text.alias("text"))
    rows = rows.select("id", "uid", F.explode(_pieces(F.col("text"), 0)).alias("p"))
    made = _lane_sums(rows.select("id", "uid", "p.kind", "p.piece"), ["id", "uid"])
    return made.select(F.col("id").alias(id_col), F.struct("exact", "signs").alias("print"))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are smaller than ``key``: binary search in a literal."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.try_element_at(table, at + s) < key), at + s).otherwise(at),
    )


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    One row per input row: ``id_col``, ``n_chars``, ``edited_sha256``, ``print``,
    ``edited_print`` (structs), ``near_edited`` and ``near_next``. In descending
    order of the id (null ids last, rows of one id by text) each text has a next
    one, the last the first. The edited text has the last ``floor(n / 2)`` code
    points replaced by the first as many, or all, of the next text.

    Null texts count as empty. The next of a single row is itself. Rows are dealt
    by ranges of ids, whose bounds are ids of the table, so the row after the last
    of a range is the one at a bound: it is sent to both ranges. Texts are
    shuffled once; the bounds (at most ``MAX_RANGES``) are all the driver sees.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top")).first()
    ranges = max(1, min(MAX_RANGES, math.ceil(size["n"] / ROWS_PER_RANGE)))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [F.lit(i / ranges) for i in range(1, ranges)]
        found = rows.agg(F.percentile_approx("key", F.array(*cuts), 10 * ranges).alias("b")).first()["b"]
        bounds = sorted({int(b) for b in found} - {size["top"]})
    own = _range_of(F.col("key"), bounds)
    # the bound after those smaller than the key is the only one that can equal it
    following = F.try_element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("own") + 1) if bounds else F.lit(None).cast("long")
    at_bound = following.eqNullSafe(F.col("key"))
    is_top = F.col("key") == F.lit(size["top"])
    ghost = F.when(is_top, F.lit(0)).when(at_bound, F.col("own") + 1)
    dealt = (
        rows.withColumn("own", own)
        .withColumn("copies", F.concat(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost"))), F.when(ghost.isNotNull(), F.array(F.struct(ghost.alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array())))
        .select("id", "key", "text", F.explode("copies").alias("c"))
        .select("id", "key", "text", "c.range", "c.ghost")
    )
    order = Window.partitionBy("range").orderBy("ghost", F.col("key").desc(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next"), F.lit(1), half))
    placed = (
        dealt.withColumn("place", F.row_number().over(order))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.when(~F.col("ghost"), edited))
    )
    keys = ["range", "ghost", "place", "id", "n_chars", "edited_sha256"]
    pieces = F.when(F.col("ghost"), _pieces(F.col("text"), 0)).otherwise(F.concat(_pieces(F.col("text"), 0), _pieces(F.col("edited"), 1)))
    exploded = placed.select(
        "range", "ghost", "place", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(pieces).alias("p")
    )
    summed = _lane_sums(exploded.select(*keys, "p.which", "p.kind", "p.piece"), [*keys, "which"])
    prints = summed.select(*keys, "which", F.struct("exact", "signs").alias("print"))
    # a row's text, its edited text, the next row's text
    line = Window.partitionBy("range").orderBy("place", "which")
    joined = prints.withColumn("edited_print", F.lead("print", 1).over(line)).withColumn("next_print", F.lead("print", 2).over(line))
    return joined.where((F.col("which") == 0) & ~F.col("ghost")).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "print", "edited_print",
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )

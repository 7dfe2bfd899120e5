"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before encoding at places where the splitting pattern
always ends a match, so the ids are those of the whole text while the regular
expression and the merge loop only ever see pieces of bounded length:

* between a character that is no white space and a following white space;
* between a letter or digit and a following character of another class
  (letter, digit, other), white space aside.

Every match of the pattern is a contraction, a run of one class with at most
one leading space, or white space, so neither cut lies inside a match, and the
look-ahead of the white-space branch only looks at characters of its own piece.
A single run of one class is never cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, to_arrow

PIECE_CHARS = 1 << 16
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")
_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}


def load(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token, rank per line), once per worker."""
    if (rank_file, pattern) not in _LOADED:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries, each piece at least ``size`` long but
    for the last, and no longer than the run that reaches over its end."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text column replaced by ``ids_col`` (array of int).

    Null texts count as empty; an empty text has no ids. Other columns pass
    through unread, under any name but ``ids_col``.
    """
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            texts, start, size, held = batch.column("text"), 0, 0, []
            for i in range(batch.num_rows):
                ids = pa.array(encode_text(encoding, texts[i].as_py()), pa.int32())
                held.append(ids)
                size += len(ids)
                if size >= 2 << 20 or i + 1 == batch.num_rows:
                    offsets = pa.array([0, *_ends(held)], pa.int32())
                    listed = pa.ListArray.from_arrays(offsets, pa.concat_arrays(held)).cast(target.field("ids").type)
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, len(held)), listed], schema=target)
                    start, size, held = i + 1, 0, []

    return rows.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids_col))


def _ends(parts: list[pa.Array]) -> Iterator[int]:
    total = 0
    for p in parts:
        total += len(p)
        yield total


def decode(docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with a further binary column: the raw bytes of the ids (null
    ids: empty). Bytes need not be valid UTF-8."""
    keep = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), docs[f"`{ids_col}`"].alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("bytes", T.BinaryType())])
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("ids")
            start, size, held = 0, 0, []
            for i in range(batch.num_rows):
                raw = encoding.decode_bytes(ids[i].as_py() or [])
                held.append(raw)
                size += len(raw)
                if size >= 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([rows.slice(start, len(held)), pa.array(held, pa.binary())], schema=target)
                    start, size, held = i + 1, 0, []

    return rows.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("bytes").alias(out))





"""Binary token-id shards with Elias-Fano document boundaries.

One file per shard, in ascending id order over all shards:

    ids        n_ids little-endian integers of 2 bytes (vocabulary up to
               65,536) or 4 bytes, documents one after another
    bounds     Elias-Fano sequence of the n_docs end offsets
    keys       Elias-Fano sequence of the ascending document ids, less the first
    footer     JSON: counts, widths, section sizes
    trailer    footer length (4 bytes), ``EFTOK001``

An Elias-Fano sequence of n values up to u keeps ``floor(log2(u / n))`` low
bits of each value as they are and the high parts in unary, about
``2 + log2(u / n)`` bits a value. Every 256th set bit of the unary part has a
sampled position, so ``select`` looks at one short stretch; neither the file nor a
reader has a table of 64-bit offsets. A writer keeps two numbers per document of its
shard until it closes, and packs the sequences block by block.

Encoding works on a batch's bytes as a whole: numpy marks the places where the
byte-level pattern always ends a match, Arrow's dictionary encoding finds the distinct
units between them, each distinct unit is encoded once, and the ids of the batch are
one gather.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdcmart.session import range_partitions

from .common import materialize, scratch_path, shuffle_partitions, text_of, to_arrow

MAGIC = b"EFTOK001"
SAMPLE = 256
#: Values packed at once; a multiple of SAMPLE.
BLOCK = 1 << 14
CACHE_UNITS = 1_000_000
READ_BYTES = 4 << 20

class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return EliasFano(0, 0, b"", b"", b"")
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        top = int(int(values[-1]) >> low_bits) + n - 1
        high, low, samples = np.zeros(top // 8 + 1, np.uint8), [], []
        for start in range(0, n, BLOCK):
            part = values[start : start + BLOCK]
            at = (part >> np.uint64(low_bits)).astype(np.int64) + np.arange(start, start + len(part))
            np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
            samples.append(at[::SAMPLE].astype("<u4"))
            bits = ((part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low.append(np.packbits(bits.ravel(), bitorder="little").tobytes())  # whole bytes: BLOCK is a multiple of 8
        return EliasFano(n, low_bits, b"".join(low), high.tobytes(), np.concatenate(samples).tobytes())

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low, self.high.tobytes(), self.samples.tobytes()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``: select over one stretch of the bits."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.int64)
        block = start // SAMPLE
        first = int(self.samples[block])
        last = int(self.samples[-(-stop // SAMPLE)]) if -(-stop // SAMPLE) < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + first // 8 * 8
        ones = ones[ones >= first]
        skip = start - block * SAMPLE
        ones = ones[skip : skip + stop - start]
        high = ones - np.arange(start, stop)
        if not self.low_bits:
            return high.astype(np.int64)
        a, b = start * self.low_bits, stop * self.low_bits
        raw = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
        low = (raw.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return (high.astype(np.int64) << self.low_bits) + low

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.slice(i, i + 1)[0])


def _ends() -> np.ndarray:
    """Per byte: 1 where an ASCII letter, 2 where any other visible ASCII character."""
    kind = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = 1 if chr(b).isalpha() else 2
    return kind


_KIND = _ends()
_POINTS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 ``data`` before which the byte-level pattern always ends a
    match: a space after a visible character, a punctuation mark after a letter. A
    character counts as visible or a letter here if it is ASCII or one of ``À`` to
    ``ÿ`` but ``×`` and ``÷``; where another stands the unit just goes on."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    before = data[:-1]
    letter, visible = _KIND[before] == 1, _KIND[before] > 0
    latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    letter[1:] |= latin
    visible[1:] |= latin
    after = data[1:]
    return np.flatnonzero(((after == 0x20) & visible) | (_POINTS[after] & letter)) + 1


class UnitEncoder:
    """Encodes whole texts, remembering the ids of common units. ``added``: the
    strings of added tokens are matched, as by the library's plain call; else
    they are ordinary text."""

    def __init__(self, tokenizer_file: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.encode = tokenizer.encode
        self.memo: dict[bytes, bytes] = {}
        self.vocabulary = tokenizer.get_vocab_size()
        strings = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = [s.encode() for s in strings]
        self.plain = Tokenizer.from_file(tokenizer_file) if strings else tokenizer

    def unit(self, unit: bytes) -> bytes:
        found = self.memo.get(unit)
        if found is None:
            found = array("I", self.encode(unit.decode(), None, False, False).ids).tobytes()
            if len(unit) <= 64:
                self.memo[unit] = found
        return found

    def block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes ``data`` and, for every offset of ``cuts`` (ascending, the
        last the length of ``data``), the number of ids before it. Units end at cuts."""
        if len(self.memo) > CACHE_UNITS:
            self.memo.clear()
        marks = np.zeros(len(data) + 1, bool)
        marks[unit_starts(data)] = marks[cuts] = marks[0] = marks[-1] = True
        starts = np.flatnonzero(marks).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        made = list(map(self.unit, coded.dictionary.to_pylist()))
        if not made:
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        which = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        per_unit = sizes[which]
        ends = np.concatenate([[0], np.cumsum(per_unit)])
        pick = np.repeat(first[which] - ends[:-1], per_unit) + np.arange(ends[-1])
        return np.frombuffer(b"".join(made), np.uint32)[pick], ends[np.searchsorted(starts, cuts)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a string column, in order, in one or more pieces
        each; the piece that ends a text is followed by None."""
        held, size = [], 0
        for value in column:
            raw = value.as_buffer().to_pybytes()
            if any(s in raw for s in self.added):  # rare: the library cuts the whole text
                yield from self._blocks(held)
                held, size = [], 0
                yield np.array(self.plain.encode(raw.decode(), None, False, False).ids, np.uint32)
                yield None
                continue
            held.append(raw)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from self._blocks(held)
                held, size = [], 0
        yield from self._blocks(held)

    def _blocks(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"".join(raws), np.uint8)
        cuts = np.cumsum([len(r) for r in raws])
        at = text = 0
        while text < len(raws):
            stop = len(data)
            if stop - at > 2 * BLOCK_BYTES:  # a long text: up to the last safe place of a stretch
                near = unit_starts(data[at : at + BLOCK_BYTES])
                ends = [at + int(near[-1])] if len(near) else []
                stop = ends[0] if ends else int(cuts[text])
            inside = cuts[text:][cuts[text:] <= stop]
            ids, places = self.block(data[at:stop], np.append(inside, stop) - at)
            low = 0
            for place in places[:-1]:
                yield ids[low:place]
                yield None
                low = place
            if low < len(ids):
                yield ids[low:]
            text, at = text + len(inside), stop


#: Bytes of text encoded as one block.
BLOCK_BYTES = 4 << 20

_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(tokenizer_file: str, added: bool = False) -> UnitEncoder:
    if (tokenizer_file, added) not in _ENCODERS:
        _ENCODERS[tokenizer_file, added] = UnitEncoder(tokenizer_file, added)
    return _ENCODERS[tokenizer_file, added]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


MANIFEST = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())]
)


def write_store(
    docs: DataFrame, tokenizer_file: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    added_tokens: bool = False,
) -> DataFrame:
    """Encode ``docs`` and write the shards below ``folder`` (default: a new one
    in the shared folder); returns the manifest, one row per shard: ``shard``,
    ``file``, ``n_docs``, ``n_ids`` and ``start`` (ids of all shards before).

    Documents are range-partitioned by id, so shard order is id order; rows of
    one id are ordered by text and null ids come first. The number of shards follows
    the input's bytes. Each task writes its
    own shard under a name of its attempt and moves it into place, so a task
    that runs again replaces its file with the same bytes. Null texts count as
    empty; every document ends with ``end_id``. An empty table has no shard.
    The special tokens of the tokenizer are not added; where a text spells an
    added token, ``added_tokens`` says whether that is the token or plain text.
    """
    spark = docs.sparkSession
    root = folder or scratch_path(spark, "tokens")
    n = range_partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # the beginning of the text parts the rows of one id (or of none), in the order of the sort
    ranges = F.col("id").asc_nulls_first(), F.substring("text", 1, 64)
    rows = rows.repartitionByRange(n, *ranges).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    target = to_arrow(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, out, ends, keys, total = context.partitionId(), None, array("q"), array("q"), 0
        nulls = 0
        encode = encoder(tokenizer_file, added_tokens)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        kind = f"<u{width}"
        tail = np.array([end_id], kind).tobytes()
        name = f"{root}/shard-{shard:06d}"
        part = f"{name}.attempt-{context.taskAttemptId()}"
        for batch in batches:
            if out is None:
                files, path = _open(part)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = files.open_output_stream(path)
            listed = iter(batch.column("id").to_pylist())
            for ids in encode.texts(batch.column("text")):
                if ids is not None:
                    out.write(ids.astype(kind).tobytes())
                    total += len(ids)
                    continue
                out.write(tail)
                total += 1
                ends.append(total)
                key = next(listed)
                nulls += key is None
                if key is not None:
                    keys.append(key)
        if out is None:
            return
        listed = np.frombuffer(keys, np.int64)
        base = int(listed[0]) if len(listed) else 0
        sections = []
        for values in (np.frombuffer(ends, np.int64), listed.astype(np.uint64) - np.uint64(base % (1 << 64))):
            ef = EliasFano.build(values)
            raw = ef.parts()
            for r in raw:
                out.write(r)
            sections.append({"n": ef.n, "low_bits": ef.low_bits, "sizes": [len(r) for r in raw]})
        footer = json.dumps({"width": width, "n_docs": len(ends), "n_ids": total, "nulls": nulls, "base": base, "bounds": sections[0], "keys": sections[1]}).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        out.close()
        files.move(path, _open(f"{name}.eftok")[1])
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{name}.eftok"]), pa.array([len(ends)]), pa.array([total])], schema=target)

    manifest = materialize(rows.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """Reader of one shard file; random access by document number."""

    def __init__(self, uri: str) -> None:
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        self.width = self.meta["width"]
        at, read = self.meta["n_ids"] * self.width, []
        for s in (self.meta["bounds"], self.meta["keys"]):
            raw = []
            for k in s["sizes"]:
                raw.append(self.file.read_at(k, at))
                at += k
            read.append(EliasFano(s["n"], s["low_bits"], *raw))
        self.bounds, self.keys = read

    def offsets(self, start: int, stop: int) -> np.ndarray:
        """Boundaries of documents ``start`` to ``stop``, one more than documents."""
        first = self.bounds.select(start - 1) if start else 0
        return np.concatenate([[first], self.bounds.slice(start, stop)])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        nulls = self.meta["nulls"]
        some = self.keys.slice(max(0, start - nulls), max(0, stop - nulls)) + self.meta["base"]
        return [None] * max(0, min(stop, nulls) - start) + some.tolist()

    def ids(self, first: int, last: int) -> np.ndarray:
        raw = self.file.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


READ = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_store(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the shards: ``id_col``, ``start`` (ids of all
    documents before it) and ``ids`` (little-endian unsigned 32-bit integers,
    end id included). Shards are read in stretches of a few megabytes."""
    target = to_arrow(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(uri)
                n, at = shard.meta["n_docs"], 0
                while at < n:
                    bounds = shard.offsets(at, min(n, at + 4096))
                    fit = int(np.searchsorted(bounds, bounds[0] + READ_BYTES // 4, "right")) - 1
                    stop = at + max(1, min(fit, len(bounds) - 1))
                    bounds = bounds[: stop - at + 1]
                    ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                    cut = ((bounds - bounds[0]) * 4).tolist()
                    parts = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids(at, stop), pa.int64()), pa.array(bounds[:-1] + base, pa.int64()), pa.array(parts, pa.binary())], schema=target
                    )
                    at = stop

    spread = manifest.select("shard", "file", "start").repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(run, READ).withColumnRenamed("id", id_col)

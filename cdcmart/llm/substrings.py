"""Removal of repeated substrings by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts in a document of
a smaller id is removed. The corpus is parsed and sorted as in prefix-free
parsing (Boucher et al., "Prefix-free parsing for building big BWTs", 2019):

* **Triggers.** A rolling hash is taken of every ``k`` bytes; of the k-grams in
  each ``length``-byte window the one of the least hash is the window's trigger
  (the leftmost of equals). Every window has one, and equal windows have equal
  triggers.
* **Phrases.** Successive windows with the same trigger form a phrase; phrases
  overlap by ``length - 1`` bytes, so every window lies within exactly one. The
  parse of a chunk of documents is its sequence of phrases.
* **Dictionary.** Distinct phrases with the smallest document that has each.
  Highly repetitive text has a small dictionary.
* **Order.** The windows of the dictionary are sorted by content within the
  bucket of their trigger: the dictionary's suffix array to depth ``length``.
  Since phrases overlap by ``length - 1``, that order alone decides which windows
  of the corpus are equal; the parse adds the order by document id. A run of
  equal neighbours is a set of equal strings, and the least document of the run
  is the one that keeps them.

Spark moves little besides. Chunks first exchange four bytes per distinct
trigger and learn which of them other documents have (one bit each). Only phrases
of such triggers are sent on, once per chunk, and a mask of windows comes back.
The documents themselves move as compressed chunks. All matches are decided on
the bytes, hashes only choose what is compared.

A line that many documents share, with other text around it in each, is a trigger with
as many distinct phrases. Chunks also say how many more than one phrase a trigger has in
them; where that makes :data:`HOT_PHRASES` or more in all (and not just copies of one
phrase in many chunks), every chunk learns so (a second bit) and parses that trigger's
windows as phrases of their own, dealt by the hash of the window: equal windows still
meet, but the trigger is split over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of, to_arrow

LENGTH = 50
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20
#: Phrases of one trigger from which on it is split by window.
HOT_PHRASES = 20_000
_LAST = np.int64(2**63 - 1)  # order of rows without an id: after all others
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS


def _sums(raw: np.ndarray) -> np.ndarray:
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw))[0][: len(raw)], out=sums[1:])
    return sums


def _rolling(raw: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Mixed 64-bit hash of the k bytes from each position."""
    sums = _sums(raw) if sums is None else sums
    h = (sums[k:] - sums[:-k]) * _powers(len(raw))[1][: len(raw) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Parse:
    """Phrases of a list of texts: ``doc``, ``at`` (first window), ``n``
    (windows), ``h`` (hash of the trigger) and ``content`` (hash of the phrase) of
    each, in text order."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.texts, self.length, self.k = texts, length, length // 2 + 1
        doc, at, n, h, content = [], [], [], [], []
        for own in self._segments():
            found = self._segment(own)
            for held, x in zip((doc, at, n, h, content), found, strict=True):
                held.append(x)
        self.doc, self.at, self.n = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (doc, at, n))
        self.h, self.content = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (h, content))

    def _segments(self) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of ``(text, offset, bytes)`` of about a chunk; a longer text is
        cut with an overlap of a window less one byte."""
        held, size, step = [], 0, CHUNK_BYTES
        for i, text in enumerate(self.texts):
            for at in range(0, max(1, len(text) - self.length + 1), step):
                part = text if len(text) <= step else text[at : at + step + self.length - 1]
                if len(part) < self.length:
                    continue
                if held and size + len(part) > step:
                    yield held
                    held, size = [], 0
                held.append((i, at, part))
                size += len(part)
        if held:
            yield held

    def _segment(self, own: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(p for _, _, p in own), np.uint8)
        sizes = np.array([len(p) for _, _, p in own])
        first = np.cumsum(sizes) - sizes
        sums = _sums(raw)
        h = _rolling(raw, self.k, sums)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, wide = 1, self.length - self.k + 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if wide > width:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that start in the last length - 1 bytes of a text do not count
        ends = first + sizes
        mark = np.zeros(len(raw) + 2, np.int32)
        np.add.at(mark, ends - self.length + 1, 1)
        np.add.at(mark, ends, -1)
        valid = (np.cumsum(mark[: len(trigger)]) == 0)
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
        stops = valid.copy()
        stops[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
        at, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        which = np.searchsorted(first, at, "right") - 1
        docs = np.array([i for i, _, _ in own])[which]
        offset = np.array([o for _, o, _ in own])[which]
        content = (sums[stop + self.length - 1] - sums[at]) * _powers(len(raw))[1][at]
        return docs, at - first[which] + offset, stop - at, h[trigger[at]], content

    def triggers(self) -> np.ndarray:
        """Sorted distinct trigger hashes."""
        return np.unique(self.h)

    def more_phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """The triggers with several distinct phrases here, and how many more than one."""
        values, counts = np.unique(self.h, return_counts=True)
        often = np.flatnonzero(np.isin(self.h, values[counts > 1]))
        order = often[np.lexsort((self.content[often], self.h[often]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.h[order[1:]] != self.h[order[:-1]]) | (self.content[order[1:]] != self.content[order[:-1]])
        values, counts = np.unique(self.h[order[new]], return_counts=True)
        return values[counts > 1], counts[counts > 1] - 1

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Replace the phrases of ``hot`` triggers by their windows, each a phrase whose
        ``h`` is the hash of its bytes; returns these hashes."""
        those = np.isin(self.h, hot)
        runs = list(zip(self.doc[those].tolist(), self.at[those].tolist(), self.n[those].tolist(), strict=True))
        hashes = [_rolling(np.frombuffer(self.texts[d][a : a + n + self.length - 1], np.uint8), self.length) for d, a, n in runs]
        made = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = self.n[those]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.doc, self.at, self.n, self.h = (
            np.concatenate([self.doc[~those], np.repeat(self.doc[those], n)]), np.concatenate([self.at[~those], np.repeat(self.at[those], n) + inner]),
            np.concatenate([self.n[~those], np.ones(len(inner), np.int64)]), np.concatenate([self.h[~those], made]),
        )
        return np.unique(made)

    def shared_here(self) -> np.ndarray:
        """Sorted trigger hashes that two texts or more of this chunk have."""
        order = np.lexsort((self.doc, self.h))
        h, doc = self.h[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        values, counts = np.unique(h[new], return_counts=True)
        return values[counts > 1]

    def dictionary(self, shared: np.ndarray, ids: np.ndarray) -> Dictionary:
        return Dictionary(self, shared, ids)


class Dictionary:
    """Distinct phrases of a chunk that have a shared trigger, in order of first
    occurrence: ``phrases``, ``least`` (smallest id) and ``h``; ``runs`` are the
    phrase occurrences and ``entry`` their phrases."""

    def __init__(self, parse: Parse, shared: np.ndarray, ids: np.ndarray) -> None:
        place = np.searchsorted(shared, parse.h)
        place[place == len(shared)] = 0
        self.runs = np.flatnonzero(shared[place] == parse.h) if len(shared) else np.zeros(0, np.int64)
        seen: dict[bytes, int] = {}
        entry = np.empty(len(self.runs), np.int64)
        more = parse.length - 1
        for j, (d, a, n) in enumerate(zip(parse.doc[self.runs].tolist(), parse.at[self.runs].tolist(), parse.n[self.runs].tolist(), strict=True)):
            entry[j] = seen.setdefault(parse.texts[d][a : a + n + more], len(seen))
        self.entry, self.phrases = entry, list(seen)
        self.least = np.full(len(seen), _LAST)
        np.minimum.at(self.least, entry, ids[parse.doc[self.runs]])
        self.h = np.zeros(len(seen), np.uint64)
        self.h[entry] = parse.h[self.runs]


def _pack(*parts: bytes) -> bytes:
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4 * n, []
    for size in np.frombuffer(raw[: 4 * n], "<u4").tolist():
        out.append(raw[at : at + size])
        at += size
    return out


CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())])
SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())])


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in compressed chunks of about ``CHUNK_BYTES`` of text; a longer
    text is a chunk of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"))
    target = to_arrow(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            keys = np.array([_LAST if i is None else i for i in ids], np.int64)
            none = np.array([i is None for i in ids], np.int8)
            lens = np.array([len(t) for t in texts], np.int64)
            blob = zstandard.ZstdCompressor(level=3).compress(
                np.array([len(ids)], np.int64).tobytes() + keys.tobytes() + none.tobytes() + lens.tobytes() + b"".join(texts)
            )
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([blob], pa.binary())], schema=target)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if ids and size + len(text) > CHUNK_BYTES:
                    yield made()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield made()

    return rows.mapInArrow(run, CHUNKS)


def _read_chunk(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ids = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    none = np.frombuffer(raw[8 + 8 * n : 8 + 9 * n], np.int8).astype(bool)
    ends = 8 + 17 * n + np.cumsum(np.frombuffer(raw[8 + 9 * n : 8 + 17 * n], np.int64))
    begins = np.concatenate([[8 + 17 * n], ends[:-1]]) if n else ends
    return ids, none, [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and the places of their hashes, in order."""
    own = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(own[places[0]]), places


def _shared(right: pa.Table, triggers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The triggers that the replies mark as those of other chunks too, and as hot."""
    replies = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
    marked = np.zeros((2, len(triggers)), bool)
    for b, places in _by_bucket(triggers, buckets):
        if reply := replies.get(b):
            bits = np.unpackbits(np.frombuffer(reply, np.uint8).reshape(2, -1), axis=1, count=len(places))
            marked[:, places] = bits.astype(bool)
    return triggers[marked[0]], triggers[marked[1]]


def _question(found: np.ndarray, places: np.ndarray, many: np.ndarray, more: np.ndarray) -> bytes:
    """What a chunk sends of its triggers ``found[places]`` (ascending): their number,
    four bytes of each, and the place and further phrases of those with several."""
    own = found[places]
    at = np.searchsorted(own, many)
    at[at == len(own)] = 0
    here = own[at] == many
    return b"".join([
        np.array([len(own)], "<u4").tobytes(), (own >> np.uint64(32)).astype("<u4").tobytes(),
        at[here].astype("<u4").tobytes(), more[here].astype("<u4").tobytes(),
    ])


def _answers(questions: list[bytes], hot_phrases: int) -> list[bytes]:
    """Per question two bits for each trigger: others have it; it is hot."""
    sent, further = [], []
    for q in questions:
        n = int(np.frombuffer(q[:4], "<u4")[0])
        sent.append(np.frombuffer(q[4 : 4 + 4 * n], "<u4"))
        further.append(np.frombuffer(q[4 + 4 * n :], "<u4").reshape(2, -1))
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    extra = np.zeros(len(values), np.int64)
    for own, (at, more) in zip(sent, further, strict=True):
        np.add.at(extra, np.searchsorted(values, own[at]), more)
    # copies of one phrase in many chunks are no reason to split
    hot = (counts + extra >= hot_phrases) & (2 * extra >= counts)
    out = []
    for own in sent:
        place = np.searchsorted(values, own)
        out.append(np.packbits(np.stack([counts[place] > 1, hot[place]]), axis=1).tobytes())
    return out


def sort_windows(phrases: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a dictionary to depth ``length``: for its windows the
    phrase, and the class (windows of equal content share one); third the number
    of windows of each phrase.

    A window whose rolling hash no other window has is a class of its own; the
    others are sorted by all their bytes, and their classes ascend with the
    content.
    """
    counts = np.array([len(p) - length + 1 for p in phrases], np.int64)
    raw = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    sizes = counts + length - 1
    first = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(phrases)), counts)
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    classes = np.arange(len(at))
    if not len(at):
        return phrase, classes, counts
    h = _rolling(raw, length)[at]
    by_hash = np.argsort(h)
    same = h[by_hash[1:]] == h[by_hash[:-1]]
    again = np.zeros(len(at), bool)
    again[:-1] |= same
    again[1:] |= same
    some = by_hash[again]
    words, starts = [], at[some]
    for off in range(0, length, 8):
        word = np.zeros(len(some), np.uint64)
        for j in range(off, min(off + 8, length)):
            word = (word << np.uint64(8)) | raw[starts + j]
        words.append(word)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(some), bool)
    for word in words:
        own = word[order]
        new[1:] |= own[1:] != own[:-1]
    classes[some[order]] = len(at) + np.cumsum(new)
    return phrase, classes, counts


def _masks(table: pa.Table, length: int) -> pa.Table:
    """Replies of one bucket: per phrase sent, the mask of its windows that a
    smaller document has too."""
    chunks, sent = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    seen: dict[bytes, int] = {}
    entries, leasts = [], []
    for blob in sent:
        sizes, docs, raw = _unpack(blob, 3)
        at, own = 0, []
        for size in sizes:
            own.append(seen.setdefault(raw[at : at + size], len(seen)))
            at += size
        entries.append(np.array(own, np.int64))
        leasts.append(np.frombuffer(docs, np.int64))
    phrases = list(seen)
    least = np.full(len(phrases), _LAST)
    for own, docs in zip(entries, leasts, strict=True):
        np.minimum.at(least, own, docs)
    phrase, classes, counts = sort_windows(phrases, length)
    first = np.full(int(classes.max(initial=-1)) + 1, _LAST)
    np.minimum.at(first, classes, least[phrase])
    first_of = first[classes]
    begin = np.cumsum(counts) - counts
    out = []
    for own, docs in zip(entries, leasts, strict=True):
        n = counts[own]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = first_of[np.repeat(begin[own], n) + inner] < np.repeat(docs, n)
        masks = np.zeros(len(own), np.uint64)
        np.bitwise_or.at(masks, np.repeat(np.arange(len(own)), n), hit.astype(np.uint64) << inner.astype(np.uint64))
        out.append(_pack(masks.astype("<u8").tobytes()))
    return pa.table({"bucket": table.column("bucket"), "chunk": pa.array(chunks, pa.int64()), "data": pa.array(out, pa.binary())})


RESULT = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _cut(parse: Parse, entries: Dictionary, masks: np.ndarray, ids: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Removed spans of each text."""
    own = parse.doc[entries.runs]
    full = ids[own] > entries.least[entries.entry]
    mask = np.where(full, np.uint64(0xFFFFFFFFFFFFFFFF), masks[entries.entry])
    n = parse.n[entries.runs]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = (np.repeat(mask, n) >> inner.astype(np.uint64)) & np.uint64(1) > 0
    doc, start = np.repeat(own, n)[hit], (np.repeat(parse.at[entries.runs], n) + inner)[hit]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    bounds = np.searchsorted(doc, np.arange(len(parse.texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            yield []
            continue
        s = start[a:b]
        gap = np.flatnonzero(np.diff(s) > parse.length)  # touching runs are one span
        yield list(zip(s[np.concatenate([[0], gap + 1])].tolist(), (s[np.append(gap, len(s) - 1)] + parse.length).tolist(), strict=True))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_phrases: int = HOT_PHRASES
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``n_removed``, ``spans``
    (maximal removed byte ranges ``start`` to ``stop``) and ``kept`` (the
    remaining bytes, which need not be valid UTF-8).

    Texts are taken as UTF-8 bytes, null as empty; texts shorter than ``length``
    lose nothing. Strings are compared on the input. Rows of one id never cut one
    another. Rows without an id come after all ids and do not cut one another. An
    empty table gives an empty result. ``length`` is at most 126.
    """
    if not 2 <= length <= 126:
        raise ValueError("length must be from 2 to 126")
    chunks = materialize(_chunks(docs, id_col, text_col), "chunks")
    size = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(8, -(-4 * size // BUCKET_BYTES))
    target = to_arrow(SENT)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                parse = Parse(_read_chunk(blob.as_py())[2], length)
                found, several = parse.triggers(), parse.more_phrases()
                rows = [(b, _question(found, places, *several)) for b, places in _by_bucket(found, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows]), pa.array([chunk] * len(rows)), pa.array([d for _, d in rows], pa.binary())], schema=target)

    def count(table: pa.Table) -> pa.Table:
        replies = _answers(table.column("data").to_pylist(), hot_phrases)
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "data": pa.array(replies, pa.binary())})

    marks = materialize(chunks.mapInArrow(ask, SENT).groupBy("bucket").applyInArrow(count, SENT), "marks")

    def parsed(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, Parse, Dictionary]:
        ids, none, texts = _read_chunk(left.column("data")[0].as_py())
        parse = Parse(texts, length)
        others, hot = _shared(right, parse.triggers(), buckets)
        shared = np.union1d(others, parse.shared_here())
        if len(hot):
            shared = np.union1d(np.setdiff1d(shared, hot), parse.split(hot))
        return ids, none, parse, parse.dictionary(shared, ids)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        entries = parsed(left, right)[3]
        rows = []
        for b, places in _by_bucket(entries.h, buckets):
            own = [entries.phrases[i] for i in places.tolist()]
            rows.append((b, _pack(bytes(map(len, own)), entries.least[places].tobytes(), b"".join(own))))
        chunk = left.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})

    sent = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, SENT)
    masks = materialize(sent.groupBy("bucket").applyInArrow(lambda table: _masks(table, length), SENT), "masks")
    replies = marks.withColumn("mask", F.lit(False)).union(masks.withColumn("mask", F.lit(True)))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        is_mask = right.column("mask").to_numpy(zero_copy_only=False).astype(bool)
        ids, none, parse, entries = parsed(left, right.filter(pa.array(~is_mask)))
        found = np.zeros(len(entries.phrases), np.uint64)
        own = right.filter(pa.array(is_mask))
        replies = dict(zip(own.column("bucket").to_pylist(), own.column("data").to_pylist(), strict=True))
        for b, places in _by_bucket(entries.h, buckets):
            found[places] = np.frombuffer(_unpack(replies[b], 1)[0], "<u8")
        rows: dict[str, list] = {"id": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for i, spans in enumerate(_cut(parse, entries, found, ids)):
            text, at, kept = parse.texts[i], 0, []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            rows["id"].append(None if none[i] else int(ids[i]))
            rows["n_bytes"].append(len(text))
            rows["n_removed"].append(sum(b - a for a, b in spans))
            rows["spans"].append([{"start": a, "stop": b} for a, b in spans])
            rows["kept"].append(b"".join([*kept, text[at:]]))
        schema = to_arrow(RESULT)
        return pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    made = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, RESULT)
    return made.withColumnRenamed("id", id_col)

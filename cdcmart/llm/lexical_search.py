"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is the sparse vector of its terms' impacts, an item the sparse vector
of its terms' weights; a score is their inner product, in 64-bit integers:

    w(term)      = floor(1000 ln((2N + 2) / (2 df + 1)))
    m(doc)       = 50 + (50 n N) div L
    impact       = (10^9 tf) div (1000 tf + 20 m)

Items are taken in blocks of bounded text. For a block, every document is read
once where it lies and reduced to the term counts that the block's items can
touch. Each task then builds ball trees over blocks of its documents and answers
all items of the block best-first: a ball with centre c and radius r holds no
inner product above <q, c> + |q| r, where |q| counts only the item's terms that some
document of the ball has (the others add nothing to any product). Subtrees whose
bound, rounded up by more than the floating error, lies below the k-th score found so
far are pruned; leaves are scored in integers.

Tasks return at most k rows an item; Spark ranks them. No document is left out and
no text cut.

Defined results: a null text has no terms; items without terms, or none of whose
terms occurs, have no rows; every row of the item table is an item of its own;
repeated document ids are separate documents, null ids come after others of equal
score; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of, to_arrow

K = 50
#: Text of the items of one block, and their number: what goes to every task.
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 4_096
#: Documents and term counts of one tree; documents of a leaf; term counts of one task.
TREE_DOCS = 16_384
TREE_COUNTS = 1 << 22
LEAF_DOCS = 128
TASK_COUNTS = 1 << 22
CHUNK = 4 << 20
#: Relative allowance over any floating error of a bound (sums of at most 10^6 doubles).
SAFE = 1e-9

# A term is a run of digits, ASCII letters and characters beyond ASCII: in UTF-8
# every byte of the latter is 0x80 or more, so bytes can be classed one by one.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # ASCII letters only


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """Number of terms of a UTF-8 text, and of each term. Long texts are counted
    in stretches that end between terms."""
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and _BYTES[raw[end]] != 0x20:
            end += 1
        words = raw[at:end].translate(_BYTES).split()
        n += len(words)
        counts.update(words)
        at = end
    return n, counts


@dataclass(frozen=True)
class Items:
    """A block of items: ids and term numbers (of the block's vocabulary)."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about :data:`BLOCK_BYTES` of text."""
    held = items.select("item_id", text_of("text").alias("text"))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["bytes"] // BLOCK_BYTES), -(-size["n"] // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for b in range(n if size["n"] else 0):
        rows = held.where(block == b).orderBy(F.col("item_id").asc_nulls_last(), "text").collect()
        vocabulary: dict[bytes, int] = {}
        terms = []
        for row in rows:
            found = sorted(term_counts(row["text"].encode())[1])
            terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found], np.int64))
        yield Items([r["item_id"] for r in rows], terms, vocabulary)


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document with a term: number of its terms, and the counts of the
    vocabulary's terms in it."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.LongType())),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, terms, tfs, ends = [], [], [], [], [0]
            for i, raw in enumerate(batch.column("text")):
                n, counts = term_counts(raw.as_buffer().to_pybytes())
                if not n:
                    continue
                for t in counts.keys() & vocabulary.keys():
                    terms.append(vocabulary[t])
                    tfs.append(counts[t])
                keep.append(i)
                sizes.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            arrays = [
                batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, to_arrow(schema), strict=True)], schema=to_arrow(schema))

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(count, schema)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Rows:
    """Sparse rows: the values of row i are ``at[i]:at[i + 1]`` of the arrays."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> None:
        self.at, self.term, self.value, self.whole, self.doc = at, term, value, whole, doc
        self.norm = self.sums(value * value)

    def __len__(self) -> int:
        return len(self.doc)

    def sums(self, per_value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_value, self.at[:-1]) if len(per_value) else np.zeros(len(self), per_value.dtype)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self.sums(dense[self.term] * self.value)

    def take(self, rows: np.ndarray) -> _Rows:
        sizes = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(self.at[rows] - at[:-1], sizes) + np.arange(at[-1])
        return _Rows(at, self.term[pick], self.value[pick], self.whole[pick], self.doc[rows])


class BallTree:
    """Balls over sparse rows (each with a value): children of a ball are the two
    halves of its rows, nearer to one or the other of two far rows. The centres
    are kept by term, so the bounds of all balls for one item are one sum over the
    item's terms."""

    def __init__(self, rows: _Rows, dims: int, leaf: int = LEAF_DOCS) -> None:
        self.leaves: dict[int, _Rows] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.radius: list[float] = []
        self._scratch = np.zeros(dims)
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(rows, None)]
        while todo:
            part, parent = todo.pop()
            node = len(centres)
            if parent is not None:
                self.children[parent] = (*self.children.get(parent, ()), node)
            terms, centre, distance = self._ball(part)
            centres.append((terms, centre))
            self.radius.append(math.sqrt(distance.max()))
            if len(part) <= leaf:
                self.leaves[node] = part
                continue
            side = np.argsort(self._side(part, distance), kind="stable")
            half = len(part) // 2
            todo += [(part.take(np.sort(side[:half])), node), (part.take(np.sort(side[half:])), node)]
        term = np.concatenate([c[0] for c in centres])
        order = np.argsort(term, kind="stable")
        self._ball_of = np.repeat(np.arange(len(centres)), [len(c[0]) for c in centres])[order]
        self._centre = np.concatenate([c[1] for c in centres])[order]
        self._at = np.searchsorted(term[order], np.arange(dims + 1))
        self._radii = np.array(self.radius)

    def _ball(self, rows: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre (terms and values) and the squared distance of every row from it,
        never below the true one."""
        total = np.bincount(rows.term, weights=rows.value, minlength=len(self._scratch))
        terms = np.flatnonzero(total)
        centre = total[terms] / len(rows)
        self._scratch[terms] = centre
        dots = rows.dot(self._scratch)
        self._scratch[terms] = 0.0
        size = float(centre @ centre)
        return terms, centre, np.maximum(rows.norm - 2 * dots + size, 0.0) + SAFE * (rows.norm + size)

    def _side(self, rows: _Rows, distance: np.ndarray) -> np.ndarray:
        def from_row(i: int) -> np.ndarray:
            at = slice(rows.at[i], rows.at[i + 1])
            self._scratch[rows.term[at]] = rows.value[at]
            dots = rows.dot(self._scratch)
            self._scratch[rows.term[at]] = 0.0
            return rows.norm - 2 * dots + rows.norm[i]

        one = from_row(int(distance.argmax()))
        return one - from_row(int(one.argmax()))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every ball, a number that no inner product inside it exceeds."""
        sizes = self._at[terms + 1] - self._at[terms]
        ends = np.cumsum(sizes)
        pick = np.repeat(self._at[terms] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        ball, weight = self._ball_of[pick], np.repeat(weights, sizes)
        near = np.bincount(ball, weights=weight * self._centre[pick], minlength=len(self._radii))
        inside = np.bincount(ball, weights=weight * weight, minlength=len(self._radii))  # terms that the ball has
        return (near + np.sqrt(inside) * self._radii) * (1 + SAFE) + 1

    def best_first(self, bounds: np.ndarray) -> Iterator[tuple[float, _Rows]]:
        """Leaves by falling bound; a ball is opened when its bound is the highest."""
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if node in self.leaves:
                yield -bound, self.leaves[node]
            else:
                for child in self.children[node]:
                    heapq.heappush(heap, (-min(bounds[child], -bound), child))


@dataclass(frozen=True)
class _Search:
    """Answers a block of items inside a task."""

    items: Items
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    leaf: int
    tree_docs: int
    schema: T.StructType

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in self.items.ids]
        for ids, rows in self.trees(batches):
            self.answer(ids, rows, best)
        columns: list[list] = [[], [], [], []]
        for i, found in enumerate(best):
            for low, _, doc in found:
                for column, value in zip(columns, (i, self.items.ids[i], doc, -low), strict=True):
                    column.append(value)
        fields = to_arrow(self.schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def trees(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, _Rows]]:
        """Blocks of documents as sparse rows, with the documents' ids."""
        held: list[pa.RecordBatch] = []
        docs = counts = 0
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs += len(part)
                counts += len(part.column("terms").flatten())
                if docs >= self.tree_docs or counts >= TREE_COUNTS:
                    yield self.rows(held)
                    held, docs, counts = [], 0, 0
        if held:
            yield self.rows(held)

    def rows(self, held: list[pa.RecordBatch]) -> tuple[list, _Rows]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, n = table.column("doc_id").to_pylist(), table.column("n").to_numpy()
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column("terms").chunks])
        term = np.concatenate([c.flatten().to_numpy() for c in table.column("terms").chunks]).astype(np.int64)
        tf = np.concatenate([c.flatten().to_numpy() for c in table.column("tfs").chunks])
        lengths, place = np.unique(n, return_inverse=True)
        m = np.array([50 + (50 * int(x) * self.n_docs) // self.n_terms for x in lengths], np.int64)[place]
        whole = impacts(tf, np.repeat(m, sizes))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        used = (self.weights[term] > 0) & (whole > 0)
        term, whole, doc = term[used], whole[used], doc[used]
        docs, first = np.unique(doc, return_index=True)
        value = whole.astype(np.float64)
        return ids, _Rows(np.append(first, len(doc)), term, value, whole, docs)

    def answer(self, ids: list, rows: _Rows, best: list[list[tuple]]) -> None:
        if not len(rows):
            return
        tree = BallTree(rows, len(self.weights), self.leaf)
        dense = np.zeros(len(self.weights), np.int64)
        for i, terms in enumerate(self.items.terms):
            terms = terms[self.weights[terms] > 0]
            if not len(terms):
                continue
            found = best[i]
            dense[terms] = self.weights[terms]
            for bound, leaf in tree.best_first(tree.bounds(terms, self.weights[terms].astype(np.float64))):
                least = -found[-1][0] if len(found) == self.k else 1
                if bound < least:
                    break
                scores = leaf.sums(dense[leaf.term] * leaf.whole)
                hits = np.flatnonzero(scores >= least)
                if len(hits):
                    new = [(-int(scores[h]), ids[leaf.doc[h]] is None, ids[leaf.doc[h]]) for h in hits]
                    found[:] = heapq.nsmallest(self.k, found + new, key=_order)
            dense[terms] = 0


def _order(row: tuple) -> tuple:
    return row[:2] if row[1] else row


def search(docs: DataFrame, items: DataFrame, k: int = K, leaf: int = LEAF_DOCS, tree_docs: int = TREE_DOCS) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score``, best first, equal scores by ascending ``doc_id``. ``leaf`` and ``tree_docs``: documents
    of a leaf and of a tree."""
    schema = T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"], docs.schema["doc_id"], T.StructField("score", T.LongType())])
    answers = [a for block in _item_blocks(items) if (a := _answer_block(docs, block, k, leaf, tree_docs, schema)) is not None]
    return reduce(DataFrame.unionByName, answers or [_ranked(docs.sparkSession.createDataFrame([], schema), k)])


def _answer_block(docs: DataFrame, items: Items, k: int, leaf: int, tree_docs: int, schema: T.StructType) -> DataFrame | None:
    if not items.vocabulary:
        return None
    vectors = materialize(_vectors(docs, items.vocabulary), "term-counts")
    size = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("counts")).first()
    if not size["docs"]:
        return None
    # one row per term of the block's items
    dfs = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(items.vocabulary), np.int64)
    for row in dfs:
        weights[row["term"]] = max(0, term_weight(size["docs"], row["count"]))
    tasks = max(1, -(-size["counts"] // TASK_COUNTS))
    run = _Search(items, weights, size["docs"], size["terms"], k, leaf, tree_docs, schema)
    touched = vectors.where(F.size("terms") > 0).repartition(tasks)
    return _ranked(touched.mapInArrow(run, schema), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

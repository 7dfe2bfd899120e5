"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is trained with numpy from
confirmed toxic texts (P) and unlabelled texts (U). Its risk estimator is the
one of Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk
Estimator" (2017):

    risk = prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss; where the second term would be negative, the step goes
against it, which keeps the model from fitting the unlabelled part's hidden
positives as negatives. The class prior is the share of toxic rows among all
training labels, aggregated on Spark.

Features say that a lower-cased word, or a word's first four or five characters
(inflected forms share them), occurs once, twice or three times and more in the
text. Of these the fit keeps those whose document frequencies in P and U differ
by ``MIN_Z`` standard errors and by ``MIN_EFFECT`` or more, which needs no label but
that of P: with few positives the errors decide, with many the effect does. Ids may be
of any type; of rows that repeat an id with other texts one is read, always the
same. The score is ``sigmoid(bias + sum of the weights of the features present)``.

Training reads a bounded sample (``max_positive`` and ``max_unlabelled`` rows,
the smallest hashes of the ids); scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, to_arrow

DIMENSIONS = 1 << 20
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MIN_Z = 2.0
MIN_EFFECT = 0.02
LEVELS = 3
STEPS = 300
RATE = 0.05
DECAY = 3e-4
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def word_keys(word: str) -> list[bytes]:
    """The word and, where it is longer, its first four and five characters."""
    keys = [b"w" + word.encode("utf-8", "surrogatepass")]
    for n in (4, 5):
        if len(word) > n:
            keys.append(b"%d" % n + word[:n].encode("utf-8", "surrogatepass"))
    return keys


def slots(key: bytes) -> list[int]:
    """Hashed feature of a key for each level of occurrences."""
    return [crc32(b"%d" % level + key) % DIMENSIONS for level in range(1, LEVELS + 1)]


def features(text: str) -> np.ndarray:
    """Sorted distinct feature slots of a whole text."""
    counts: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for key in word_keys(word):
            counts[key] += n
    return np.array(sorted({s for key, n in counts.items() for s in slots(key)[:n]}), np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text divides by five. Null ids
    are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss. Without
    positives, unlabelled texts or telling features the score is the prior
    everywhere (at most 0.4, so nothing is rejected)."""
    prior = min(max(prior, 1e-3), 0.4)
    bias, weights = float(np.log(prior / (1 - prior))), np.zeros(DIMENSIONS, np.float32)
    if not positive or not unlabelled:
        return Model(weights, bias)
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = _frequency(positive), _frequency(unlabelled)
    effect = np.abs(in_p - in_u)
    telling = (effect >= MIN_Z * np.sqrt((in_u + 1 / n_p) / n_p)) & (effect >= MIN_EFFECT)
    used = np.flatnonzero(telling)
    if not len(used):
        return Model(weights, bias)
    held = [x[telling[x]] for x in (*positive, *unlabelled)]  # a small part of all features
    sizes = [len(x) for x in held]
    rows, idx = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(used, np.concatenate(held))
    p = np.arange(len(sizes)) < n_p
    w = np.append(np.zeros(len(used)), bias)  # the last weight is the bias
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[idx], len(sizes))
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_clean = np.logaddexp(0, z)  # l(-f)
        g = np.empty(len(sizes))
        if as_clean[~p].mean() >= prior * as_clean[p].mean():
            g[p], g[~p] = -prior / n_p, up[~p] / n_u  # l(f) - l(-f) = -f
        else:  # step back out of the negative risk
            g[p], g[~p] = prior * up[p] / n_p, -up[~p] / n_u
        slope = np.append(np.bincount(idx, g[rows], len(used)) + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def _frequency(texts: list[np.ndarray]) -> np.ndarray:
    """Share of the texts that have each feature."""
    counts = np.zeros(DIMENSIONS, np.float32)
    for x in texts:
        counts[x] += 1  # features of a text are distinct
    return counts / len(texts)


def _sample(rows: DataFrame, id_col: str, text_col: str, n: int) -> list[np.ndarray]:
    """Features of the ``n`` rows of least id hash, taken on the executors."""
    order = F.xxhash64(F.col(id_col), F.lit(10))
    kept = rows.select(id_col).distinct().orderBy(order, id_col).limit(n)
    chosen = rows.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(kept), id_col)  # n ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], names=["id", "f"])

    made = chosen.select(F.col(id_col).cast("string").alias("key"), "text").mapInArrow(run, "id string, f binary")
    # of rows that repeat an id, one whatever their order; n rows at most
    kept = made.groupBy("id").agg(F.min("f").alias("f")).collect()
    return [np.frombuffer(r["f"], np.int32) for r in sorted(kept, key=lambda r: r["id"])]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Fit on the training fold: toxic rows as positives, a sample of the
    fold's documents, labels unseen, as the unlabelled part."""
    marks = labels.where(~held_out(id_col)).where(F.col(label_col).isNotNull()).select(id_col, label_col)
    prior = marks.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    if not prior:
        return fit([], [], 0.0)
    toxic = marks.where(F.col(label_col) == 1).select(id_col).distinct()
    toxic = toxic.orderBy(F.xxhash64(F.col(id_col), F.lit(10)), id_col).limit(max_positive)
    fold = docs.where(~held_out(id_col)).select(id_col, text_col)
    return fit(
        _sample(fold.join(F.broadcast(toxic), id_col), id_col, text_col, max_positive),  # max_positive ids at most
        _sample(fold, id_col, text_col, max_unlabelled),
        prior,
    )


class Scorer:
    """Scores whole texts, remembering which words have weights."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.bias = bias

        class Memo(dict):
            def __missing__(self, word: str) -> tuple:
                found = []
                for key in word_keys(word):
                    levels = [float(weights[s]) for s in slots(key)]
                    if any(levels):
                        found.append((key, levels))
                value = self[word] = tuple(found)
                return value

        self.memo = Memo()

    def __call__(self, text: str) -> float:
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
        counts: Counter = Counter()
        levels: dict[bytes, list[float]] = {}
        for found in filter(None, map(self.memo.__getitem__, _WORD.findall(text.lower()))):
            for key, own in found:
                counts[key] += 1
                levels[key] = own
        z = self.bias + sum(sum(levels[key][:n]) for key, n in counts.items())
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row.

    Only the text enters the score; a null text counts as empty, and a text
    without words gets the score of the bias. An existing column named ``out``
    is replaced; all others pass through.
    """
    keep = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    target = to_arrow(schema)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 MB: DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in batches:
            scores = pa.array([scorer(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores], schema=target)

    return rows.mapInArrow(run, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(out))

"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of word bytes and runs of punctuation, case kept. Features are hashed single tokens and token pairs,
and two pooled ones: words all in capitals, and a token that repeats the one before it. A text's value of a feature is its count over the
root of its number of features, so a score is one sparse dot product.

Training reads at most ``TRAIN_ROWS`` labelled rows, those of the smallest hash of their doc_id among the rows whose crc32(doc_id) mod 5 is
not 0, and the whole text of each (where a doc_id has several, the one whose features are least as bytes), so copies neither weigh more nor are gathered. They
stream past one task, once an epoch; a document travels as its distinct features and their counts. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts score by the intercept alone; rows without labels score like any other; no labelled
row at all gives every text the score 0.5; a null doc_id is not held out; repeated rows come out as often as they go in; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import map_pieces, utf8

TRAIN_ROWS = 8000
BUCKETS = 1 << 18
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.3, 0.1, 3
_CAPS, _REPEAT, _INTERCEPT = BUCKETS, BUCKETS + 1, BUCKETS + 2

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD = tc.IS_WORD.copy()
_WORD[65:91] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all documents on end, with n + 1 offsets; a feature stands as often as it occurs."""
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = np.where(_SPACE[data], 0, np.where(_WORD[data], 1, 2))
    body = kind[1:-1]
    opens = (body > 0) & (body != kind[:-2])
    closes = (body > 0) & (body != kind[2:])
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] |= body[edges] > 0
    closes[edges - 1] |= body[edges - 1] > 0
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, bounds).astype(np.int64)
    hashes = tc.span_hash(tc.prefix_hash(data), starts, ends)
    n = len(starts)
    sums = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int32)))
    lows = np.concatenate(([0], np.cumsum(_LOWER[data], dtype=np.int32)))
    caps = (sums[ends] - sums[starts] >= 2) & (lows[ends] == lows[starts])
    fresh = np.zeros(n, bool)
    fresh[first[:-1][first[:-1] < n]] = True
    follows = ~fresh
    repeat = np.zeros(n, bool)
    repeat[1:] = (hashes[1:] == hashes[:-1]) & follows[1:]
    pair = np.zeros(n, np.uint64)
    pair[1:] = tc.gram_hashes(hashes, 2)
    table = np.stack(((hashes % np.uint64(BUCKETS)).astype(np.int32), (pair % np.uint64(BUCKETS)).astype(np.int32), np.full(n, _CAPS, np.int32), np.full(n, _REPEAT, np.int32)), axis=1)
    there = np.stack((np.ones(n, bool), follows, caps, repeat), axis=1)
    counts = np.concatenate(([0], np.cumsum(there.sum(axis=1))))
    return table[there], counts[first]


class Learner:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 3), np.zeros(BUCKETS + 3)

    def weight(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(i == _INTERCEPT, 0, L1), 0)
        return -shrunk / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)

    def update(self, label: int, i: np.ndarray, count: np.ndarray) -> None:
        """One document: its distinct features and how often each occurs."""
        x = np.append(count / np.sqrt(max(count.sum(), 1)), 1.0)
        i = np.append(i, _INTERCEPT)
        w, n = self.weight(i), self.n[i]
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] += g * g


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of a model of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.distinct()), "doc_id")

    def listed(piece: pa.RecordBatch) -> pa.RecordBatch:
        seen, first = features(*utf8(piece.column("text")))
        raw = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            i, count = np.unique(seen[a:b], return_counts=True)
            raw.append(np.concatenate((i, count)).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(raw, pa.binary())], ["doc_id", "label", "seen"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, some = Learner(), False
        for batch in batches:
            for label, seen in zip(batch.column("label").to_pylist(), batch.column("seen")):
                i, count = np.frombuffer(seen.as_buffer(), np.int32).reshape(2, -1)
                model.update(label, i, count)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([model.weight(np.arange(BUCKETS + 3)).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    found = map_pieces(texts, "text", listed, "doc_id long, label int, seen binary").groupBy("doc_id", "label").agg(F.min("seen").alias("seen"))
    passes = found.select("*", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id", "label")
    got = ordered.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(got[0].weights), np.float32).astype(np.float64) if got else np.zeros(BUCKETS + 3)


def scores(weights: np.ndarray, text: pa.Array) -> np.ndarray:
    seen, first = features(*utf8(text))
    sums = np.concatenate(([0.0], np.cumsum(weights[seen])))
    dots = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1)) + weights[_INTERCEPT]
    return np.round(1 / (1 + np.exp(-np.clip(dots, -35, 35))), 9)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(weights.value, piece.column("text"))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", step, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay. ``training`` holds the labelled texts."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted(training, labels))

    def step(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(scores(weights.value, piece.column("text")) >= THRESHOLD))

    return map_pieces(docs, "text", step, docs.schema)

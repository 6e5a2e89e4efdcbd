"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Every coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so the model is a
short list of (bucket, weight) pairs that goes to every task. A document's features are the distinct buckets of its
words, of its pairs of neighbours and of its pairs of words with one or two words between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import ship

#: Buckets the grams are hashed into, as a power of two; bounds the model and what is broadcast.
BITS = 20
#: Words between the two of a pair: none for neighbours.
GAPS = (0, 1, 2)
#: Words of a text looked at together, so that a very long one needs bounded memory.
PIECE = 1 << 16
#: Remembered words per process.
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W_]+")
_MIX = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KNOWN: dict[str, int] = {}


def _hashes(words: list[str]) -> np.ndarray:
    known = _KNOWN
    if len(known) > REMEMBERED:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def grams(words: np.ndarray) -> list[np.ndarray]:
    """Buckets of the word hashes and, by gap, of their pairs; the k-th array's i-th entry begins at word i."""
    out = [_bucket(words)]
    for gap, mix in zip(GAPS, _MIX):
        first, second = words[: -gap - 1], words[gap + 1 :]
        out.append(_bucket(first * mix + (second ^ (second >> np.uint64(29)))))
    return out


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of one whole text; none for an empty one."""
    found = [np.zeros(0, np.int32)]
    for words in _pieces(text):
        found += [np.unique(g) for g in grams(words)]
    return np.unique(np.concatenate(found))


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the text's words, piece by piece; a piece begins with the last words of the one before."""
    lower = (text or "").lower()
    if len(lower) <= 4 * PIECE:
        words = _WORD.findall(lower)
        if words:
            yield _hashes(words)
        return
    own: list[str] = []
    for match in _WORD.finditer(lower):
        own.append(match[0])
        if len(own) >= PIECE:
            yield _hashes(own)
            own = own[-max(GAPS) - 1 :]
    yield _hashes(own)


@dataclass
class Model:
    """Log-odds of a text without features, and the buckets (sorted) with a weight other than zero."""

    base: float
    buckets: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._table = None

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.buckets] = self.weights
        return self._table

    def __getstate__(self):
        return {"base": self.base, "buckets": self.buckets, "weights": self.weights, "_table": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Only buckets with a weight are made distinct, so a clean text costs little more than its words."""
        table = self.table()
        owner, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for i, text in enumerate(texts):
            for words in _pieces(text):
                own = np.concatenate(grams(words))
                own = own[table[own] != 0]
                if len(own):
                    owner.append(np.full(len(own), i))
                    bucket.append(own)
        pairs = np.unique(np.concatenate(owner) << BITS | np.concatenate(bucket))
        sums = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], len(texts)) + self.base
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def fit(rows: list[tuple[np.ndarray, float]], *, alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, epochs: int = 3) -> Model:
    """FTRL-proximal over (features, label) rows in the given order, ``epochs`` times.

    ``l1`` is a thousandth of the number of rows, 8 at least, unless given: the sums it is compared with grow with the rows.
    Labels are weighted so that both classes count alike. Without labels the model scores 0.5, with one class only the
    share of label 1, smoothed.
    """
    ones = sum(y for _, y in rows)
    base = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5))) if rows else 0.0
    none = np.zeros(0, np.int32)
    l1 = max(8.0, len(rows) / 1000) if l1 is None else l1
    if not rows or ones in (0, len(rows)):
        return Model(base, none, none.astype(np.float32))
    share = {1.0: len(rows) / (2 * ones), 0.0: len(rows) / (2 * (len(rows) - ones))}
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last one is the intercept, without L1
    least = np.full((1 << BITS) + 1, l1)
    least[-1] = 0.0

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= least[at], 0.0, -(own - np.sign(own) * least[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for found, y in rows:
            at = np.append(found, 1 << BITS)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * share[y]
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / alpha * w
            n[at] = after
    w = weights(np.arange((1 << BITS) + 1))
    kept = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), kept.astype(np.int32), w[kept].astype(np.float32))


def held_out():
    """crc32(doc_id as text) mod 5 is 0; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


_MODEL = "base double, buckets binary, weights binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "features"])


def _fitted(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(f.as_py(), np.int32), y.as_py()) for b in batches for y, f in zip(b.column(0), b.column(1))]
        model = fit(rows, **settings)
        yield pa.RecordBatch.from_arrays([
            pa.array([model.base]), pa.array([model.buckets.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()),
        ], ["base", "buckets", "weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 16_000, **settings) -> Model:
    """Fit on the labelled documents that are not held out, on ``sample_rows`` of them (by a hash of doc_id) at most.

    Labels other than 0 and 1 and null doc_ids are passed over; a doc_id with several labels takes their majority, 1
    in a tie. The sampled ids are broadcast, their documents read in parallel, and one task passes over their
    features in a fixed order; the driver gets the weights that are not zero.
    """
    marks = labels.filter("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("y"))
    picked = marks.filter(F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = picked.select("doc_id", (F.col("y") >= 0.5).cast("double").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").mapInArrow(_featured, "doc_id long, y double, features binary")
    one = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample_rows).select("y", "features")
    found = one.repartition(1).sortWithinPartitions(F.xxhash64("features"), "features", "y").mapInArrow(_fitted(settings), _MODEL).first()
    if found is None:
        return fit([])
    return Model(found["base"], np.frombuffer(found["buckets"], np.int32), np.frombuffer(found["weights"], np.float32))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted (score >= 0.5) of every row.

    Only the text enters a score. A null text scores like an empty one, at the log-odds of a text without features;
    repeated rows score alike; rows without doc_id are scored and not learnt from. A very long text is read piece by
    piece, each gram counted once. Other columns are not read. An empty table gives no rows. ``settings`` are those of
    :func:`train` and :func:`fit`.
    """
    ship(docs.sparkSession)
    model = train(docs, labels, **settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Quality classifier: an additive model of single features and pairs of features.

Shallow trees on one binned feature at a time are boosted in turn, each adding to that feature's lookup table; then
trees on the pairs of features that explain most of what is left. A score is the sum of the table entries of a
document's bins, so scoring is a few vectorised look-ups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import without
from placemap.sources.storage import stored

FEATURES = (
    "log_words", "word_chars", "long_words", "distinct_words", "top_word", "same_neighbours", "distinct_pairs",
    "duplicate_lines", "log_line_words", "upper", "digits", "marks", "symbols", "shouts", "non_ascii", "deflated",
)
_LETTERS_UPPER = bytes(range(65, 91))
_LETTERS = _LETTERS_UPPER + bytes(range(97, 123))
_DIGITS, _MARKS, _SYMBOLS, _SHOUTS = b"0123456789", b".,;:", b"#*$%&|<>@{}[]\\^~=+_/", b"!?"
_HIGH = bytes(range(128, 256))
#: Bytes deflated at a time.
PIECE = 1 << 20


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def features(text: str | None) -> tuple[float, ...]:
    """The features of one whole text; an empty text has the values of an empty list of words."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = max(_count(raw, _LETTERS), 1)
    deflated = sum(len(zlib.compress(raw[at : at + PIECE], 1)) for at in range(0, len(raw), PIECE))
    per = max(n, 1)
    return (
        np.log1p(n), sum(map(len, words)) / per, sum(len(w) > 20 for w in counts) / max(len(counts), 1),
        np.log1p(len(counts)) / np.log1p(per), max(counts.values(), default=0) / per, same / per, pairs / max(n - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), _count(raw, _LETTERS_UPPER) / letters,
        _count(raw, _DIGITS) / size, _count(raw, _MARKS) / per, _count(raw, _SYMBOLS) / per, _count(raw, _SHOUTS) / per,
        1 - len(raw.translate(None, _HIGH)) / size if raw else 0.0, deflated / size,
    )


@dataclass
class Model:
    """Cuts of each feature, its table of log-odds per bin, and such tables for pairs of features."""

    cuts: list[np.ndarray]
    base: float = 0.0
    singles: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.singles):
            total += table[b[:, i]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]) if len(gain) else -1.0), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over one feature's bins, as its value in every bin."""
    gain, at = _best_cut(g, h, least) if depth else (-1.0, 0)
    if gain <= g.sum() ** 2 / (h.sum() + 1) + 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, least), _tree(g[at:], h[at:], depth - 1, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """The best tree that cuts one feature and each half by the other."""
    best = None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            halves = [_tree(a[s].sum(0), b[s].sum(0), 1, least) for s in (slice(at), slice(at, None))]
            gain = sum(float((a[s].sum(0) * v).sum()) for s, v in zip((slice(at), slice(at, None)), halves))
            if best is None or gain > best[0]:
                out = np.concatenate([np.tile(halves[0], (at, 1)), np.tile(halves[1], (len(a) - at, 1))])
                best = gain, out.T if turned else out
    return best[1] if best else np.zeros(g.shape)


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 20) -> Model:
    """Boost in turn. Without labels the model scores 0.5, with one class only the share of label 1, smoothed."""
    width = x.shape[1]
    model = Model([np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(width)])
    model.singles = [np.zeros(len(c) + 1) for c in model.cuts]
    model.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)
    least = min(3.0, 0.05 * y.mean() * (1 - y.mean()) * len(y))  # of the second derivatives in a leaf

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(width):
            g, h = slopes()
            size = len(model.singles[i])
            step = rate * _tree(np.bincount(b[:, i], g, size), np.bincount(b[:, i], h, size), 2, least)
            model.singles[i] += step
            total += step[b[:, i]]
    g, h = slopes()
    gains = {}
    for i in range(width):
        for j in range(i):
            shape = len(model.singles[j]), len(model.singles[i])
            flat = b[:, j] * shape[1] + b[:, i]
            gg, hh = (np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            coarse = [np.add.reduceat(np.add.reduceat(m, np.arange(0, shape[0], 4), 0), np.arange(0, shape[1], 4), 1) for m in (gg, hh)]
            gains[j, i] = float((coarse[0] ** 2 / (coarse[1] + 5)).sum())
    for i, j in sorted(gains, key=gains.get, reverse=True)[:pairs]:
        model.pairs[i, j] = np.zeros((len(model.singles[i]), len(model.singles[j])))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            flat = b[:, i] * table.shape[1] + b[:, j]
            step = rate * _pair_tree(*(np.bincount(flat, v, table.size).reshape(table.shape) for v in (g, h)), least)
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], ["doc_id", "features"])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def held_out():
    """crc32(doc_id as text) mod 3 is 1; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(featured: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, **settings) -> Model:
    """Fit on the labelled documents that are not held out, on ``sample_rows`` of them at most (by a hash of doc_id).

    Labels other than 0 and 1 and null doc_ids are passed over; a doc_id with several labels takes their majority, 1
    in a tie.
    """
    marks = labels.filter("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    rows = (
        featured.filter(~held_out()).join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample_rows)
        .select("features", (F.col("y") >= 0.5).cast("double").alias("y")).toPandas()
    )
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64), **settings)


def score_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) of every row.

    Only the text enters a score. A null text scores like an empty one; repeated rows score alike; rows without doc_id
    are scored and not learnt from. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    featured = stored(rows.mapInArrow(_featured, "doc_id long, features array<double>"), "quality-features")
    model = train(featured, labels, **settings)
    scored = featured.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, **settings) -> DataFrame:
    """The rows of docs whose text scores 0.5 or more, with their columns; the model is learnt from docs and labels.

    The documents to learn from are picked among the labels first (``sample_rows`` of them at most, which bounds what is
    broadcast), so no text is exchanged. A null text scores like an empty one and repeated rows alike; an empty table gives an empty
    one, and without labels all rows score 0.5 and stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.filter("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = marked.filter(F.col("doc_id").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = rows.join(F.broadcast(picked), "doc_id").mapInArrow(_featured, "doc_id long, features array<double>")
    model = train(stored(found, "quality-features"), labels, sample_rows=sample_rows, **settings)

    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    table = without(docs, "__score").withColumn("__score", F.arrow_udf("double")(run)(F.col("text").cast("string")))
    return table.filter(F.col("__score") >= 0.5).drop("__score")

"""Quality rules from how a public vocabulary splits a text.

Code points per token, the share of tokens that fall back to single bytes and the normalised entropy of the tokens
are measured per document. Quartiles over all documents of a language and length class, merged with those of wider groups as far as
the class is small, give the bands; a document outside one is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.encoding import vocabulary
from placemap.sources.storage import stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: What a band is at least wide on each side of the quartiles, per measure.
LEAST_MARGIN = {"chars_per_token": 0.25, "byte_share": 0.05, "entropy": 0.08}
#: Words a process remembers the tokens of.
REMEMBERED = 300_000
#: Most bands that are broadcast; more are joined.
BROADCAST_ROWS = 10_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in _COUNTS], *[(c, pa.float64()) for c in MEASURES]])
_DDL = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", " + ", ".join(f"{c} double" for c in MEASURES)


class WordTokens:
    """Token ids of single words by a sentencepiece vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else ()):
            known[w] = np.array(ids, np.uint32).tobytes()
        return [known[w] for w in words]


@lru_cache(maxsize=1)
def _words(path: str) -> WordTokens:
    return WordTokens(path)


def repeated_words(codes: np.ndarray) -> int:
    """Words inside windows of 8 words that occur twice or more; ``codes`` number the text's words."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None, tokens: WordTokens) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    times = np.bincount(codes, minlength=len(number))
    chars = sum(map(len, words)) - (np.frombuffer(raw, np.uint8) & 0xC0 == 0x80).sum()
    lines = Counter(line for line in raw.split(b"\n") if line.strip())
    packed = tokens.of(list(number))
    ids = np.frombuffer(b"".join(packed), np.uint32)
    weights = np.repeat(times, [len(p) // 4 for p in packed]) if packed else times
    total = int(weights.sum())
    sums = np.bincount(ids, weights) if len(ids) else np.zeros(0)
    share = sums[sums > 0] / max(total, 1)
    entropy = float(-(share * np.log2(share)).sum() / np.log2(total)) if total > 1 else 0.0
    in_bytes = float(weights[tokens.is_byte[ids]].sum()) / max(total, 1)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeats = repeated_words(codes) if len(number) < len(words) else 0
    return (
        len(words), int(chars), symbols, sum(lines.values()) - len(lines), repeats, total,
        int(chars) / max(total, 1), in_bytes, entropy,
    )


def _measured(vocabulary_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _words(vocabulary(vocabulary_file))
        for batch in batches:
            columns = list(zip(*[measure(t.as_py(), tokens) for t in batch.column(2)])) or [()] * (len(_SCHEMA) - 2)
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, _SCHEMA.types[2:])]]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    return run


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, *, vocabulary_file: str = "piece_bpe_32k.model", reach: float = 2.0, pool: int = 30) -> DataFrame:
    """The measures of each row with base_failed and kept.

    Bands are set per lang and length class (the binary logarithm of the number of words) by all documents the base
    rules pass: the quartiles, widened by ``reach`` times their distance, but by LEAST_MARGIN at least. The quartiles of a
    group of n documents weigh n / (n + ``pool``); the rest of the weight is that of its language over all lengths, whose
    quartiles are merged with those of all documents in the same way. A null or empty text has no words and fails the base rules; rows
    without lang form a language of their own. Repeated rows are judged alike. Other columns are not read. An empty
    table gives no rows. Quartiles are approximate percentiles, merged from all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    measured = stored(rows.mapInArrow(_measured(vocabulary_file), _DDL), "fertility")
    measured = measured.withColumn("base_failed", base_failed()).withColumn("size_class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))
    quartile = lambda c, q: F.percentile_approx(c, F.lit(q / 4), F.lit(1000))
    good, ends = measured.filter(~F.col("base_failed")), [(c, q) for c in MEASURES for q in (1, 3)]
    lang, size = F.coalesce("lang", F.lit("")).alias("__lang"), F.col("size_class").alias("__size")

    def spans_of(level: str, *by) -> DataFrame:
        return good.groupBy(*by).agg(F.count(F.lit(1)).alias(f"__n_{level}"), *[quartile(c, q).alias(f"__{c}_{q}_{level}") for c, q in ends])

    def merged(c: str, q: int):
        at = F.col(f"__{c}_{q}_all")
        for level in ("lang", "group"):
            n = F.col(f"__n_{level}")
            at = (n * F.col(f"__{c}_{q}_{level}") + pool * at) / (n + pool)
        return at.alias(f"__{c}_{q}")

    spans = spans_of("group", lang, size).join(spans_of("lang", lang), "__lang").crossJoin(spans_of("all"))
    # a row per language and length class, unless lang holds something else
    spans = stored(spans.select("__lang", "__size", *[merged(c, q) for c, q in ends]), "fertility-bands")
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    inside = F.lit(True)
    for c in MEASURES:
        low, high = F.col(f"__{c}_1"), F.col(f"__{c}_3")
        margin = F.greatest(reach * (high - low), F.lit(LEAST_MARGIN[c]))
        inside &= F.col(c).between(low - margin, high + margin)
    joined = measured.join(spans, (F.coalesce("lang", F.lit("")) == F.col("__lang")) & (F.col("size_class") == F.col("__size")), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "lang", *_COUNTS, *MEASURES, "base_failed", kept.alias("kept"))

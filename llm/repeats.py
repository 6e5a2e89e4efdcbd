"""Remove every byte that a repeated string of fixed length covers, by sorting suffixes bucket by bucket.

The cover sample is chosen by content: in every stretch of ``length`` bytes the smallest hash of 64 bytes marks one
place, its anchor. Two equal stretches have the same anchor at the same distance, so, as with a difference cover of
fixed residues, any two suffixes to be compared meet a sample place at equal distance behind their starts. A suffix
bucket is the suffixes whose anchors have one hash; buckets are sorted block by block in separate tasks. In a block the
sample suffixes (what follows the anchors) are ranked first; a longer suffix is then told from others by the rank
of the few bytes before its anchor and, where those tie, by the rank of its sample suffix. Ranks carry the lengths of
common prefixes, so equality up to ``length`` bytes needs no further look at the text.

Only anchors that a filter of twice-seen hashes holds take part; the others cannot lie in a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bloom import through_twice_seen
from llm.common import without
from placemap.sources.storage import stored

#: Bytes an anchor's hash is made of.
GRAM = 64
#: Starts looked at together, so that a very long text needs bounded memory.
PIECE = 1 << 18
#: Suffix starts of one sorted block, about.
BLOCK_ROWS = 8_192
#: Most rows of the list of large buckets that is broadcast; a longer one is joined.
BROADCAST_ROWS = 10_000
_ODD = 0x9E3779B97F4A7C15
ROWS = "h long, off int, n int, context binary, times int, members array<struct<text_id binary, start long>>"
_ARROW = pa.schema([
    ("h", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("context", pa.binary()), ("times", pa.int32()),
    ("members", pa.list_(pa.struct([("text_id", pa.binary()), ("start", pa.int64())]))),
])
SPANS = "text_id binary, begin long, end long"
_SPANS = pa.schema([("text_id", pa.binary()), ("begin", pa.int64()), ("end", pa.int64())])


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = PIECE + 4096
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, v, np.uint64)])) for v in (np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch of GRAM bytes."""
    power, inverse = _powers()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, place, first start, last start) of every anchor: the starts whose stretch it marks. By pieces."""
    for hashes, place, first, last in _anchor_arrays(raw, length):
        yield from zip(hashes.tolist(), place.tolist(), first.tolist(), last.tolist())


def _anchor_arrays(raw: bytes, length: int):
    data, width = np.frombuffer(raw, np.uint8), length - GRAM + 1
    for at in range(0, len(raw) - length + 1, PIECE):
        h = gram_hashes(data[at : min(at + PIECE + length - 1, len(data))])
        n = len(h)
        low = np.uint64(20)
        marked = ((h >> low) << low) | np.arange(n, dtype=np.uint64)  # ties go to the first place
        padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        padded[:n] = marked
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, 1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        starts = n - width + 1
        place = (np.minimum(after[:starts], before[width - 1 : n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [starts]]) - 1
        place = place[first]
        yield h[place], place + at, first + at, last + at


def _anchor_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            found = [h for t in batch.column(1) for h, *_ in _anchor_arrays((t.as_py() or "").encode(), length)]
            yield np.concatenate(found) if found else np.zeros(0, np.uint64)

    return run


def _contexts(length: int):
    """Rows of ROWS: for each suspected anchor the text its starts cover; equal ones of a batch form one row."""

    def run(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list] = {}
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                for hashes, place, first, last in _anchor_arrays(raw, length):
                    keep = np.flatnonzero(seen.holds(hashes))
                    for h, p, a, b in zip(*(v[keep].tolist() for v in (hashes.view(np.int64), place, first, last))):
                        row = rows.setdefault((h, p - a, raw[a : b + length]), [0, set()])
                        row[0] += 1
                        row[1].add((text_id, a))
            for part in _parts(list(rows.items())):
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int32()),
                    pa.array([len(k[2]) - length + 1 for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.binary()),
                    pa.array([min(v[0], 2) for _, v in part], pa.int32()),
                    pa.array([[{"text_id": t, "start": s} for t, s in v[1]] for _, v in part], _ARROW.types[5]),
                ], schema=_ARROW)

    return lambda seen, _: partial(run, seen)


def _parts(items: list, size: int = 5_000) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def _ranked(strings: list[bytes], bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings in sorted order within their buckets, and what each has in common with the one before."""
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    words = np.ascontiguousarray(table).view(">u8")
    sizes = np.array([len(s) for s in strings])
    order = np.lexsort([sizes, *words.T[::-1], bucket])  # a string before those that have NUL bytes more
    same = table[order][1:] == table[order][:-1]
    common = np.where(same.all(1), width, np.argmin(same, 1))
    sizes = sizes[order]
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[bucket[order][1:] != bucket[order][:-1]] = -1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, np.concatenate([[-1], common])


def repeated_starts(h: np.ndarray, off: np.ndarray, n: np.ndarray, context: list[bytes], times: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """For one block: rows whose start ``distance`` bytes before the anchor begins a repeated string, by distance."""
    width = -(-length // 8) * 8
    right, right_common = _ranked([c[o:] for c, o in zip(context, off)], h, width)
    left, left_common = _ranked([c[:o][::-1] for c, o in zip(context, off)], h, width)
    for distance in range(int(off.max()) + 1):
        on = np.flatnonzero((distance <= off) & (distance > off - n))
        if not len(on):
            continue
        # names of what lies before and behind the anchor, as far as this start's string reaches
        name = np.cumsum(left_common < distance)[left[on]] * (len(off) + 1) + np.cumsum(right_common < length - distance)[right[on]]
        _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
        yield on[(count[inverse] > 1) | (times[on] > 1)], distance


def _sorted_block(rows: list[tuple], length: int) -> pa.RecordBatch | None:
    h, off, n, context, times, members = zip(*rows)
    h, off, n, times = (np.array(v) for v in (h, off, n, times))
    marks = [np.zeros(k + 1, bool) for k in n]
    for on, distance in repeated_starts(h, off, n, list(context), times, length):
        for i in on.tolist():
            marks[i][off[i] - distance] = True
    ids, begin, end = [], [], []
    for mark, who in zip(marks, members):
        if mark.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mark])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                ids += [m["text_id"] for m in who]
                begin += [m["start"] + a for m in who]
                end += [m["start"] + b - 1 + length for m in who]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], schema=_SPANS) if ids else None


def _sort_buckets(length: int):
    """Rows sorted by h -> spans, block by block; a bucket is never divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(block) >= BLOCK_ROWS and row[0] != block[-1][0]:
                    if (out := _sorted_block(block, length)) is not None:
                        yield out
                    block = []
                block.append(row)
        if block and (out := _sorted_block(block, length)) is not None:
            yield out

    return run


PIECES = f"piece binary, {ROWS}"
_PIECES = pa.schema([("piece", pa.binary()), *_ARROW])


def _pieces(length: int, step: int):
    """Rows of large buckets cut into rows of at most ``step`` neighbouring starts, each in a bucket of its own.

    Starts ``d`` to ``d + step - 1`` bytes before the anchor all hold the ``d`` bytes before it and what lies behind it
    up to ``length`` less the others' distance; that core names the new bucket. Starts of equal strings lie equally far before their
    anchors and so stay together. With one start a row the core is the string itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(list(zip(*[batch.column(c).to_pylist() for c in ("h", "off", "n", "context", "times", "members")])), 500):
                rows: dict[tuple, list] = {}
                for h, off, n, context, times, members in part:
                    for at in range((off - n + 1) // step * step, off + 1, step):
                        low, high = max(at, off - n + 1), min(at + step - 1, off)
                        core = context[off - at : off - at - step + 1 + length]
                        bucket = xxhash.xxh3_64_intdigest(core, (h + at) & (2**64 - 1))
                        row = rows.setdefault((bucket, high, high - low + 1, context[off - high : off - low + length]), [0, []])
                        row[0] += times
                        row[1] += [{"text_id": m["text_id"], "start": m["start"] + off - high} for m in members]
                names = [hashlib.blake2b(b"%d %d %d " % k[:3] + k[3], digest_size=16).digest() for k in rows]
                columns = [names, np.array([k[0] for k in rows], np.uint64).view(np.int64), *zip(*[k[1:] for k in rows])]
                columns += [[min(v[0], 2) for v in rows.values()], [v[1] for v in rows.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types)], schema=_PIECES)

    return run


#: Starts a row, where a bucket is large and where it still is.
STEPS = (8, 1)


def _large(rows: DataFrame, large_bucket: int) -> DataFrame:
    """h of buckets with more than ``large_bucket`` rows; a list of few is broadcast."""
    large = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > large_bucket).select("h"), "large-buckets")
    return F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large


def repeated_spans(texts: DataFrame, *, length: int = 200, large_bucket: int = 1_024, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """text_id, begin, end (bytes) of spans that repeated strings cover, from rows (text_id binary, text string).

    Spans of a text may overlap. Equal texts have equal text_ids and count as often as they occur. A bucket of more
    than ``large_bucket`` rows is split by what its starts have in common, and of equal rows only one, with their number, goes to the same
    sorter; what it finds is joined with the texts that hold them. Where a part still is large, each start is a part, all
    rows of which are equal.
    """
    size = texts.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    expected = 2 * size // (length - GRAM + 2) + 1
    rows = stored(through_twice_seen(
        texts.select("text_id", "text"), _anchor_hashes(length), _contexts(length), ROWS, expected=expected, max_bytes=max_filter_bytes
    ), "contexts")

    def sort(buckets: DataFrame) -> DataFrame:
        return buckets.select(*_ARROW.names).repartition("h").sortWithinPartitions("h").mapInArrow(_sort_buckets(length), SPANS)

    large = _large(rows, large_bucket)
    spans = sort(rows.join(large, "h", "left_anti"))
    for step in STEPS:
        pieces = rows.join(large, "h", "left_semi").mapInArrow(_pieces(length, step), PIECES)
        context = [F.first(c).alias(c) for c in ("h", "off", "n", "context")]
        itself = F.array(F.struct(F.col("piece").alias("text_id"), F.lit(0).cast("long").alias("start"))).alias("members")
        once = pieces.groupBy("piece").agg(*context, F.least(F.sum("times"), F.lit(2)).cast("int").alias("times")).select("*", itself)
        once = stored(once, "pieces")
        found = once
        if step > 1:
            rows, large = pieces.drop("piece"), _large(once, large_bucket)
            found = once.join(large, "h", "left_anti")
        found = sort(found).withColumnRenamed("text_id", "piece")
        holders = pieces.select("piece", F.explode("members").alias("m")).join(found, "piece")
        spans = spans.unionByName(holders.select("m.text_id", (F.col("m.start") + F.col("begin")).alias("begin"), (F.col("m.start") + F.col("end")).alias("end")))
    return spans.distinct()


_CUT = "n_bytes long, spans array<struct<begin long, end long>>, kept binary"


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans):
        raw = (text.as_py() or "").encode()
        merged: list[list[int]] = []
        for s in sorted((s["begin"], s["end"]) for s in found.as_py() or ()):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        at, kept = 0, []
        for a, b in merged:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        out.append({"n_bytes": len(raw), "spans": [{"begin": a, "end": b} for a, b in merged], "kept": b"".join(kept)})
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The documents with n_bytes, spans (the maximal removed runs, in bytes) and kept (the remaining bytes).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text included; strings
    do not cross texts. Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated rows are
    elsewhere to each other. doc_id is not used. Columns of docs with the name of an added column are replaced. An
    empty table gives an empty one. ``kept`` may cut a character, hence bytes.
    """
    docs = without(docs, "n_bytes", "spans", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text_id = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    spans = repeated_spans(docs.select(text_id.alias("text_id"), text.alias("text")), **settings)
    lists = spans.groupBy(F.col("text_id").alias("__text_id")).agg(F.collect_list(F.struct("begin", "end")).alias("__spans"))
    cut = F.arrow_udf(_CUT)(_cut)
    joined = docs.withColumn("__id", text_id).join(lists, F.col("__id") == F.col("__text_id"), "left").withColumn("__r", cut(text, F.col("__spans")))
    return joined.select(*[f"`{c}`" for c in docs.columns], "__r.n_bytes", "__r.spans", "__r.kept")

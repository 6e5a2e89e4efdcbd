"""Drop lines that many documents share.

Two Bloom filters find the lines that may repeat: a line's hash enters the first when it is seen once and the second
when it is seen again. Only lines the second filter holds are exchanged, to count their documents exactly and to
choose the one that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.bloom import through_twice_seen
from llm.common import SPACE, without
from placemap.sources.storage import stored


def key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(k: bytes, least: int) -> bool:
    return len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least)


def _digest(k: bytes) -> bytes:
    return hashlib.blake2b(k, digest_size=16).digest()


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                keys = {key(line) for line in (text.as_py() or "").encode().split(b"\n")}
                found += [xxhash.xxh3_64_intdigest(k) for k in keys if long_enough(k, least)]
            yield np.array(found, np.uint64)

    return run


def _suspects(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = [k for k in {key(line) for line in (text.as_py() or "").encode().split(b"\n")} if long_enough(k, least)]
                keys += own
                owner += [doc] * len(own)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            at = np.flatnonzero(seen.holds(hashes))
            yield pa.RecordBatch.from_arrays([pa.array([owner[i] for i in at], pa.int64()), pa.array([_digest(keys[i]) for i in at], pa.binary())], schema=schema)

    return lambda seen, _: partial(run, seen)


def _without_lines(least: int):
    def run(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts, drops):
            lines = (text.as_py() or "").split("\n")
            gone = set(drop.as_py() or ())
            if gone:
                keys = [key(line.encode()) for line in lines]
                kept = [line for line, k in zip(lines, keys) if not (long_enough(k, least) and _digest(k) in gone)]
            else:
                kept = lines
            out.append({"text": "\n".join(kept), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    return run


def line_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def dedup_lines(docs: DataFrame, *, least_chars: int = 20, least_docs: int = 3, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The documents with the kept lines as text, and n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code points
    found under ``least_docs`` different doc_ids lose all their lines but those of the largest such doc_id. Rows that
    share a doc_id count as one document; a row without doc_id counts as none and keeps no such line. A null or
    empty text is one empty line. Columns of docs named n_lines or n_dropped are replaced; the others stay.

    The filter's size follows the number of lines. Up to ``max_filter_bytes`` it is broadcast; a larger one stays on the executors and
    is asked by exchanged hashes. Keys are compared by a 128-bit digest. The texts are exchanged once, to meet their list
    of dropped keys, and once more if the filter is not broadcast. An empty table gives an empty one.
    """
    docs = without(docs, "n_lines", "n_dropped")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    lines = docs.select(F.sum(line_count(text)).alias("n")).first()["n"] or 0
    # seen twice or more in documents; one row per document and key
    suspects = stored(through_twice_seen(
        docs.select(id_.alias("doc_id"), text.alias("text")), _hashes(least_chars), _suspects(least_chars), "doc_id long, digest binary",
        expected=lines, max_bytes=max_filter_bytes,
    ), "suspect-lines")
    shared = suspects.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least_docs)
    drops = (
        suspects.join(shared.select("digest", "keeper"), "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("digest").alias("__drops"))
    )
    cleaned = F.arrow_udf("text string, n_lines long, n_dropped long")(_without_lines(least_chars))
    joined = docs.join(drops, id_.eqNullSafe(F.col("__doc")), "left").withColumn("__r", cleaned(text, F.col("__drops")))
    kept = [F.col("__r.text").alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, "__r.n_lines", "__r.n_dropped")

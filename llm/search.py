"""Exact top-k search by inner product, block against block.

Within a block the candidates lie dimension by dimension. Inner products grow over blocks of dimensions; after each,
a candidate whose partial product plus the largest product its remaining dimensions can add (by the lengths of the
remaining parts) stays below the k-th best lower bound is dropped and the survivors are moved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions added between two rounds of pruning.
STEP = 16
#: Blocks of candidates there are at least, once each has some hundred rows.
LEAST_BLOCKS = 64
RESULT = "query_id long, query_key long, vec_id long, score long"
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("query_id", "query_key", "vec_id", "score")])
#: Whole numbers up to here are exact in double precision.
_EXACT = 2.0**53


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(256 x) of each component as rows; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths(), np.int64) if len(vectors) else np.zeros(0, np.int64)
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * 256)
    out = np.zeros((len(sizes), max(sizes, default=0)), np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def best(query: np.ndarray, own: int | None, columns: np.ndarray, ids: np.ndarray, tails: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best candidates other than ``own``; ``columns`` is dimension by candidate."""
    dims = len(query)
    alive = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    partial = np.zeros(len(alive))
    whole = len(alive) == len(ids)
    for step, at in enumerate(range(0, dims, STEP)):
        part = columns[at : at + STEP] if whole else columns[at : at + STEP, alive]
        partial = partial + query[at : at + STEP] @ part
        if at + STEP >= dims or len(alive) <= k:
            continue
        rest = np.sqrt((query[at + STEP :] ** 2).sum()) * tails[step + 1, alive]
        slack = 1 + 1e-9 * (np.abs(partial).max() + rest.max())  # the bounds are rounded, the products are not
        floor = np.partition(partial - rest, len(alive) - k)[len(alive) - k] - slack
        keep = partial + rest >= floor
        if keep.sum() < 0.7 * len(alive):
            alive, partial, whole = alive[keep], partial[keep], False
    if len(alive) > k:
        edge = np.partition(partial, len(partial) - k)[len(partial) - k]
        keep = partial >= edge
        alive, partial = alive[keep], partial[keep]
    order = np.lexsort((ids[alive], -partial))[:k]
    return alive[order], partial[order]


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _SCHEMA.empty_table()
        q, c = _matrix(queries["embedding"]), _matrix(candidates["embedding"])
        dims = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
        ids = candidates["vec_id"].to_numpy()
        rows: list[tuple] = []
        keys = list(zip(queries["vec_id"].to_pylist(), queries["query_key"].to_pylist()))
        if dims and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dims >= _EXACT:
            for (i, key), v in zip(keys, q):  # beyond double precision: whole numbers of any size
                scores = [sum(int(a) * int(b) for a, b in zip(v, w)) for w in c]
                rows += [(i, key, *x) for x in sorted(((int(n), s) for n, s in zip(ids, scores) if n != i), key=lambda x: (-x[1], x[0]))[:k]]
            rows = [(*r[:3], max(-(2**63), min(2**63 - 1, r[3]))) for r in rows]
        else:
            columns = np.ascontiguousarray(c.T)
            # lengths of what is left of each candidate before every step
            tails = np.array([np.sqrt((columns[at:] ** 2).sum(0)) for at in range(0, dims, STEP)] or [np.zeros(len(ids))])
            for (i, key), v in zip(keys, q):
                at, score = best(v, i, columns, ids, tails, k)
                rows += zip([i] * len(at), [key] * len(at), ids[at].tolist(), score.astype(np.int64).tolist())
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 4, schema=_SCHEMA)

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """query_id, query_key, rank (from 1), vec_id, score: the k highest scores of each query among all other rows.

    The score is the inner product of floor(256 x) of all components; ties go to the smaller vec_id. Vectors that are
    null or hold a null or non-finite component, and rows without vec_id, take no part. A shorter vector counts as
    ending in zeros. Rows with a query's vec_id are its own and never answer it; repeated candidates each count.
    Query rows that share a vec_id are told apart by query_key (a hash of the vector), equal ones are answered once.
    Scores beyond 64 bits are cut to the nearest such number. An empty table gives no rows.

    Rows are dealt into blocks of about ``block`` candidates and ``query_block`` queries; every block of queries meets
    every block of candidates in one task, which sends on k rows per query.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    chosen = good.filter(is_query).withColumn("query_key", F.xxhash64("embedding")).dropDuplicates(["vec_id", "query_key"])
    n, m = good.count(), chosen.count()
    # small tables still make enough tasks
    blocks, query_blocks = max(1, -(-n // block), min(LEAST_BLOCKS, -(-n // 256))), max(1, -(-m // query_block))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = chosen.select("vec_id", "query_key", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), every(blocks, "cb"))
    right = good.select("vec_id", "embedding", spread.cast("int").alias("cb"), every(query_blocks, "qb"))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_search(k), RESULT)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_key", "rank", "vec_id", "score")

"""Ranked lexical search: every item's best documents by a term-weighting score, with a hybrid of two evaluation orders.

Documents are indexed in blocks, each with the posting lists of the terms that items ask for. For an item and a block the
short lists are evaluated term at a time, into one list of summed scores per document; that list then takes part as one
more iterator with a known bound in a document-at-a-time evaluation of the long lists. Bounds per list and window of
documents leave out windows that cannot reach the item's k-th score so far, and inside a window only documents of the lists
that are needed to reach it are looked up in the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from llm.common import ship
from placemap.sources.storage import stored

#: Documents, and occurrences of asked terms, of one block at most (a single longer document is a block).
BLOCK_DOCS, BLOCK_TERMS = 8192, 1_000_000
#: Documents whose scores are bounded together.
WINDOW = 512
#: A list is short if it names at most one in so many documents of its block.
SHORT = 32
_NO_ID = 2**63 - 1
#: Letters and digits of ASCII and every byte beyond it make terms, with A-Z lower-cased; all else separates them.
_TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
INDEX = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
    ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _indexed(vocabulary):
    """Rows (doc_id, text) -> blocks: for every asked term of the block, sorted, how many documents, which, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        ids, lengths, asked = [], [], []
        held = 0

        def block() -> pa.RecordBatch:
            term = np.concatenate(asked)
            place = np.repeat(np.arange(len(ids)), [len(a) for a in asked])
            keys, times = np.unique(term.astype(np.int64) << 32 | place, return_counts=True)
            found, sizes = np.unique(keys >> 32, return_counts=True)
            columns = [ids, lengths, found, sizes, keys & 0xFFFFFFFF, times]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, INDEX.types)], schema=INDEX)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(text.as_py())
                if own:
                    found = [number[w] for w in own if w in number]
                    ids.append(doc)
                    lengths.append(len(own))
                    asked.append(np.array(found, np.int32))
                    held += len(found)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_TERMS:
                    yield block()
                    ids, lengths, asked, held = [], [], [], 0
        if ids:
            yield block()

    return run


class Block:
    """The lists of one block, each posting with what its document's length and its count are worth per weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, lengths = row["doc_ids"], row["lengths"].astype(np.int64)
        self.terms, self.places = row["terms"], row["places"]
        self.ends = np.concatenate([[0], np.cumsum(row["sizes"])])
        m = 25 + 75 * lengths * n_docs // n_terms
        times = row["times"].astype(np.int64)
        self.worth = 1_000_000_000 * times // (1000 * times + 8 * m[self.places])
        self.windows = -(-len(self.ids) // WINDOW)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = int(np.searchsorted(self.terms, term))
        if at == len(self.terms) or self.terms[at] != term:
            return None
        part = slice(self.ends[at], self.ends[at + 1])
        return self.places[part], self.worth[part]

    def windowed(self, term: int, places: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window begins in a long list, and the largest worth in it; computed once for all items."""
        if term not in self.long:
            self.long[term] = _windowed(places, worth, self.windows)
        return self.long[term]


def _windowed(places: np.ndarray, worth: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.searchsorted(places, np.arange(windows + 1) * WINDOW)
    most = np.zeros(windows, np.int64)
    full = cuts[1:] > cuts[:-1]
    if full.any():
        most[full] = np.maximum.reduceat(worth, cuts[:-1][full])
    return cuts, most


def summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the sum of all lists, as one list."""
    places, scores = np.concatenate([p for p, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[first], np.add.reduceat(scores[order], first)


class Best:
    """The k highest scores of one item so far; equal ones by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])  # an equal score may still have a smaller doc_id


def search(block: Block, query: list[tuple[int, int]], best: Best) -> int:
    """Offer ``best`` every document of the block that may be among its k; how many were scored.

    ``query`` has (term, weight times its number in the item).
    """
    short, lists = [], []
    for term, weight in query:
        found = block.list_of(term)
        if found is None or weight == 0:
            continue
        if len(found[0]) * SHORT <= len(block.ids):
            short.append((found[0], weight * found[1]))
        else:
            lists.append((*found, weight, *block.windowed(term, *found)))
    if short:
        places, scores = summed(short)
        lists.append((places, scores, 1, *_windowed(places, scores, block.windows)))
    if not lists:
        return 0
    bounds = np.array([weight * most for _, _, weight, _, most in lists])
    total, scored = bounds.sum(0), 0
    for window in np.argsort(-total, kind="stable"):  # the most promising first, so that the k-th score rises early
        if total[window] < best.least:
            break
        order = np.argsort(-bounds[:, window], kind="stable")
        rest = np.cumsum(bounds[order, window][::-1])[::-1]  # what this list and all after it can add
        sums = np.zeros(WINDOW, np.int64)
        candidates = None
        for at, i in enumerate(order):
            if rest[at] == 0:
                break
            places, worth, weight, cuts, _ = lists[i]
            part = slice(cuts[window], cuts[window + 1])
            own = places[part] - window * WINDOW
            if candidates is None and rest[at] < best.least:
                candidates = np.flatnonzero(sums)  # documents of no list so far cannot reach the k-th score
            if candidates is None:
                sums[own] += weight * worth[part]
                continue
            candidates = candidates[sums[candidates] + rest[at] >= best.least]
            if not len(candidates):
                break
            near = np.searchsorted(own, candidates)
            near[near == len(own)] = 0
            hit = own[near] == candidates
            sums[candidates[hit]] += weight * worth[part][near[hit]]
        candidates = np.flatnonzero(sums) if candidates is None else candidates
        scored += len(candidates)
        kept = candidates[sums[candidates] >= best.least]
        if len(kept):
            best.offer(sums[kept], block.ids[kept + window * WINDOW])
    return scored


def _searched(queries, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(k) for _ in queries.value]
        for batch in batches:
            for i in range(len(batch)):
                row = {}
                for name, column in zip(INDEX.names, batch.columns):
                    values = column[i].values
                    row[name] = values.fill_null(_NO_ID).to_numpy(zero_copy_only=False) if name == "doc_ids" else values.to_numpy(zero_copy_only=False)
                block = Block(row, n_docs, n_terms)
                for query, best in zip(queries.value, bests):
                    search(block, query, best)
        items = np.repeat(np.arange(len(bests)), [len(b.ids) for b in bests])
        ids = np.concatenate([np.zeros(0, np.int64), *[b.ids for b in bests]])
        scores = np.concatenate([np.zeros(0, np.int64), *[b.scores for b in bests]])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], schema=FOUND)

    return run


def _item_blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[list[tuple]]:
    """(item_id, its terms counted) in blocks that are bounded in items and terms; rows that share an item_id are one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    block: list[tuple] = []
    size, before = 0, False
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if block and before and row["item_id"] == block[-1][0]:
            block[-1][1].update(terms(row["text"]))
            continue
        if len(block) >= most_items or size >= most_terms:
            yield block
            block, size = [], 0
        block.append((row["item_id"], Counter(terms(row["text"]))))
        size += len(block[-1][1])
        before = True
    if block:
        yield block


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block_results(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted({t for _, counts in block for t in counts})
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    index = stored(docs.mapInArrow(_indexed(vocabulary), from_arrow_schema(INDEX)), "lexical-index")
    totals = index.select(F.sum(F.size("doc_ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df"))
    weights = {r["terms"]: weight(r["df"], n_docs) for r in lists.collect()}  # a row per term of the block of items at most
    number = vocabulary.value
    queries = [[(number[t], weights[number[t]] * times) for t, times in sorted(counts.items()) if number[t] in weights] for _, counts in block]
    queries = spark.sparkContext.broadcast(queries)
    found = index.mapInArrow(_searched(queries, n_docs, n_terms, k), from_arrow_schema(FOUND))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")  # as many as the block has items
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, block_items: int = 2000, block_terms: int = 200_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` highest-scoring documents above 0 of each item (item_id, text).

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. N counts the documents that
    have a term, L all their terms, n one document's; df the documents with a term, tf its occurrences in a document. An
    item's score for a document sums floor(1000 * ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 8m)) over the item's
    terms, repeats included, with m = 25 + 75nN div L; integers but for the logarithm. Equal scores go by ascending
    doc_id, a null one last; rows with equal doc_ids are documents of their own. Null and empty texts, and texts
    without a term, are no documents and no items; repeated rows of an item count once, different texts of one item_id are
    one item. Other columns are not read. Empty tables give no rows. A text must fit a task.

    Items are taken in blocks of ``block_items`` items and ``block_terms`` different terms or so, which bounds what is broadcast;
    every block reads all documents. A task keeps ``k`` documents per item, and its k-th score is what its next
    blocks must reach.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    results = [_block_results(rows, block, k) for block in _item_blocks(items, block_items, block_terms)]
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out

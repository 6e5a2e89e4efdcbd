"""Pack token ids of documents into sequences of a fixed length with little padding.

Bounded-space online packing. Every partition reads its documents once, sends full windows out at once and keeps
a fixed number of open windows for the ends. An end goes to the open window it fits best; if none fits and all
are in use, the fullest window is filled with the head of that end and sent out. The windows still open at the end
of each partition are merged with those of its neighbours.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.encoding import encoder, vocabulary
from placemap.sources.storage import stored

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "merge_group long, ids binary"
)
#: Rows of one output batch.
FLUSH = 20_000
#: Sequence ids of merged windows start here; a partition's own ids are its number times 2**32 plus a counter.
MERGED = 1 << 61


class Packer:
    """The open windows of one partition. Windows are lists of pieces (row without sequence and offset, ids)."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.open_windows = capacity, open_windows
        self.free: list[tuple[int, int]] = []  # room left and window, ascending
        self.windows: dict[int, list] = {}
        self.next = 0

    def add(self, piece: tuple, ids: bytes) -> Iterator[list]:
        """Place one piece of at most ``capacity`` ids; yields the windows that became full."""
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.free, (n, -1))
            if at < len(self.free):
                room, window = self.free.pop(at)
                self.windows[window].append((piece, ids))
                if room > n:
                    insort(self.free, (room - n, window))
                else:
                    yield self.windows.pop(window)
                return
            if len(self.free) < self.open_windows:
                self.windows[self.next] = [(piece, ids)]
                if n == self.capacity:
                    yield self.windows.pop(self.next)
                else:
                    insort(self.free, (self.capacity - n, self.next))
                self.next += 1
                return
            room, window = self.free.pop(0)  # the fullest; cutting the piece leaves no padding
            self.windows[window].append((piece, ids[: 4 * room]))
            yield self.windows.pop(window)
            piece, ids = (piece[0], piece[1] + room, piece[2]), ids[4 * room :]


def _rows(window: list, sequence: int, group: int | None = None) -> Iterator[tuple]:
    offset = 0
    for (doc, start, total), ids in window:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence, offset, group, ids if group is not None else None
        offset += n


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_ARROW = pa.schema([
    *[(c, pa.int64()) for c in "doc_id start length ids_crc32 doc_tokens sequence_id offset merge_group".split()],
    ("ids", pa.binary()),
])


def _pack_partition(tokenizer: str, capacity: int, open_windows: int, end_id: int, fan_in: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary(tokenizer)).encode
        number = TaskContext.get().partitionId()
        packer, sequence, rows = Packer(capacity, open_windows), number << 32, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    for window in packer.add((doc, start, total), ids[4 * start : 4 * (start + capacity)]):
                        rows.extend(_rows(window, sequence))
                        sequence += 1
                if len(rows) >= FLUSH:
                    yield _batch(rows, _ARROW)
                    rows = []
        for window in packer.windows.values():
            rows.extend(_rows(window, sequence, number // fan_in))
            sequence += 1
        if rows:
            yield _batch(rows, _ARROW)

    return pack


def _merge(capacity: int):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        group = table["merge_group"][0].as_py()
        base = MERGED + (group << 24)
        packer, rows, sequence = Packer(capacity, 1), [], base
        pieces = zip(*[table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")])
        for doc, start, total, ids in pieces:
            for window in packer.add((doc, start, total), ids):
                rows.extend(_rows(window, sequence))
                sequence += 1
        for window in packer.windows.values():
            rows.extend(_rows(window, sequence))
        return pa.Table.from_batches([_batch(rows, _ARROW)])

    return merge


def pack(
    docs: DataFrame,
    *,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    open_windows: int = 64,
    end_id: int = 0,
    fan_in: int = 32,
) -> DataFrame:
    """Pieces of the documents' ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its text's ids followed by ``end_id``; each id lies in exactly one piece. Sequences hold at
    most ``capacity`` ids and have no padding, except the last one of every ``fan_in`` partitions. Memory of a
    task: ``open_windows`` windows plus one batch; of a merge: ``fan_in * open_windows`` windows.

    A null or empty text is the end id alone. Repeated rows and null doc_ids are packed like any other; rows that
    share a doc_id share it in the result. Other columns are not read. An empty table gives no rows. The pieces are
    written to the shared folder, since a second run of a task may cut them elsewhere.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_pack_partition(tokenizer, capacity, open_windows, end_id, fan_in), PIECES), "pieces")
    left = pieces.filter("merge_group IS NOT NULL").groupBy("merge_group").applyInArrow(_merge(capacity), PIECES)
    return pieces.filter("merge_group IS NULL").unionByName(left).drop("merge_group", "ids")

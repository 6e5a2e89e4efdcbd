"""A Bloom filter of the hashes that occur more than once, built from two filters on all executors; counts of hashes.

The hashes are dealt out by segment. A segment's task passes over them once with two filters of fixed size: a hash
enters the first when it is new and the second when the first has it already. Only the second filter is kept.

The number of segments follows the number of hashes. While all of them together are small enough, they are broadcast; beyond that
they stay where they are, every block of rows sends its hashes to their segments, and the segments send back those they hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemap.sources.storage import stored

#: Bits of one segment of a filter, and bits set per hash.
SEGMENT_BITS = 1 << 20
PROBES = 5
_PACKED = pa.schema([("segment", pa.int32()), ("hashes", pa.binary())])


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each hash within its segment."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    low, step = mixed >> np.uint64(44), ((mixed >> np.uint64(20)) & np.uint64(0xFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * step) & np.uint64(SEGMENT_BITS - 1)


class TwiceSeen:
    """``holds(hashes)``: true for every hash that was seen twice, false for nearly all others."""

    def __init__(self, filters):
        self.filters = filters  # a broadcast of bytes, one row of bits per segment

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.filters.value, np.uint8).reshape(-1, SEGMENT_BITS // 8)
        segment = (hashes % np.uint64(len(bits))).astype(np.int64)
        found = np.ones(len(hashes), bool)
        for place in _places(hashes):
            found &= (bits[segment, (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _deal(hashes: Callable, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in hashes(batches):
            values, times = np.unique(found, return_counts=True)
            values = np.repeat(values, np.minimum(times, 2))
            segment = (values % np.uint64(segments)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            values, cuts = values[order], np.searchsorted(segment[order], np.arange(segments + 1))
            rows = [(s, values[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if segment not in filters:
                filters[segment] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            once, twice = filters[segment]
            values, times = np.unique(np.frombuffer(packed.as_py(), np.uint64), return_counts=True)
            places = list(_places(values))
            again = times > 1
            known = np.ones(len(values), bool)
            for place in places:
                known &= once[place]
            for place in places:
                twice[place[known | again]] = True
                once[place] = True
    for segment, (_, twice) in filters.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], schema=_PACKED
        )


def twice_seen(table: DataFrame, hashes: Callable, *, expected: int, max_bytes: int) -> TwiceSeen:
    """The filter of what ``hashes`` (batches of ``table`` -> arrays of 64-bit hashes) yields more than once.

    ``expected`` hashes get 8 bits each, ``max_bytes`` in all at most; the result is broadcast, so this bounds it.
    A task's own repeats are sent twice at most, so a hash in a third of all rows costs no segment more than that.
    """
    segments = int(min(max(1, -(-8 * expected // SEGMENT_BITS)), max(1, max_bytes * 8 // SEGMENT_BITS)))
    packed = table.mapInArrow(_deal(hashes, segments), "segment int, hashes binary")
    built = packed.repartition("segment").mapInArrow(_fill, "segment int, hashes binary")
    bits = bytearray(segments * SEGMENT_BITS // 8)
    width = SEGMENT_BITS // 8
    for row in built.toLocalIterator():
        bits[row["segment"] * width : (row["segment"] + 1) * width] = row["hashes"]
    return TwiceSeen(table.sparkSession.sparkContext.broadcast(bytes(bits)))


#: Counters of one segment.
COUNTERS = 1 << 16


class Frequencies:
    """``of(hashes)``: at least how often each occurred; more where counters are shared."""

    def __init__(self, counts):
        self.counts = counts  # a broadcast of bytes

    def of(self, hashes: np.ndarray) -> np.ndarray:
        counts = np.frombuffer(self.counts.value, np.uint32)
        return counts[_counter(hashes, len(counts))]


def _counter(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) & (size - 1)


def _deal_counts(hashes: Callable, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in hashes(batches):
            at, times = np.unique(_counter(found, size), return_counts=True)
            cuts = np.searchsorted(at, np.arange(0, size + 1, COUNTERS))
            rows = [
                (s, np.stack([at[a:b] - s * COUNTERS, times[a:b]]).astype(np.uint32).tobytes())
                for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, times = np.frombuffer(packed.as_py(), np.uint32).reshape(2, -1)
            sums.setdefault(segment, np.zeros(COUNTERS, np.uint64))[at] += times
    for segment, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], schema=_PACKED
        )


def frequencies(table: DataFrame, hashes: Callable, *, expected: int, max_counters: int = 1 << 24) -> Frequencies:
    """Counts of what ``hashes`` yields, in a counter per expected hash, ``max_counters`` or COUNTERS at most (a power of two)."""
    size = min(1 << max(16, max_counters.bit_length() - 1), max(COUNTERS, 1 << max(0, expected - 1).bit_length()))
    dealt = table.mapInArrow(_deal_counts(hashes, size), "segment int, hashes binary")
    counts = np.zeros(size, np.uint32)
    for row in dealt.repartition("segment").mapInArrow(_add_counts, "segment int, hashes binary").toLocalIterator():
        counts[row["segment"] * COUNTERS : (row["segment"] + 1) * COUNTERS] = np.frombuffer(row["hashes"], np.uint32)
    return Frequencies(table.sparkSession.sparkContext.broadcast(counts.tobytes()))


class Held:
    """``holds(hashes)`` and ``of(hashes)`` for the hashes of one block, as the segments have answered."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return self.hashes[self._at(hashes)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return np.where(self.holds(hashes), self.counts[self._at(hashes)], 1) if len(self.hashes) else np.ones(len(hashes), np.uint32)


#: Rows and bytes of one block that asks the segments together.
BLOCK_ROWS, BLOCK_BYTES = 1000, 4 << 20
_BLOCK = pa.schema([("block", pa.int64()), ("rows", pa.binary())])
_ASKED = pa.schema([("segment", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into blocks; stored, so that a block stays the same however often it is read."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES * len(batch) // max(batch.nbytes, 1)))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_BLOCK)
            number += 1


def _unpacked(rows: pa.Scalar) -> list[pa.RecordBatch]:
    return pa.ipc.open_stream(rows.as_buffer()).read_all().to_batches()


def _asking(hashes: Callable, segments: int):
    """Every block's distinct hashes by segment, and in how many of its rows' sets each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [*hashes(iter(_unpacked(rows))), np.zeros(0, np.uint64)]
                values, times = np.unique(np.concatenate(found), return_counts=True)
                segment = (values % np.uint64(segments)).astype(np.int64)
                order = np.argsort(segment, kind="stable")
                values, times = values[order], times[order].astype(np.uint32)
                names, starts = np.unique(segment[order], return_index=True)
                cuts = [*starts.tolist(), len(values)]
                columns = [
                    names, np.full(len(names), block), [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], [times[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED.types)], schema=_ASKED)

    return run


def _building(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter and the counters of each segment, as rows without a block; rows come sorted by segment."""
    open_segment, parts = None, None

    def row() -> pa.RecordBatch:
        _, twice, counts = parts
        packed = np.packbits(twice, bitorder="little").tobytes()
        columns = [[open_segment], [None], [packed], [np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED.types)], schema=_ASKED)

    for batch in batches:
        for segment, hashes, times in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if segment != open_segment:
                if parts is not None:
                    yield row()
                open_segment = segment
                parts = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool), np.zeros(COUNTERS, np.uint64)
            once, twice, counts = parts
            values, number = np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(times.as_py(), np.uint32)
            places = list(_places(values))
            known = number > 1
            inside = np.ones(len(values), bool)
            for place in places:
                inside &= once[place]
            for place in places:
                twice[place[known | inside]] = True
                once[place] = True
            np.add.at(counts, _counter(values, COUNTERS), number)
    if parts is not None:
        yield row()


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment, the segment's filter first: what it holds of each block's hashes, with their counts."""
    bits = counts = None
    for batch in batches:
        out: list[tuple] = []
        for block, hashes, times in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if block is None:
                bits = np.unpackbits(np.frombuffer(hashes.as_py(), np.uint8), bitorder="little")
                counts = np.frombuffer(times.as_py(), np.uint32)
                continue
            values = np.frombuffer(hashes.as_py(), np.uint64)
            held = np.ones(len(values), bool)
            for place in _places(values):
                held &= bits[place] == 1
            if held.any():
                own = values[held]
                out.append((block, own.tobytes(), counts[_counter(own, COUNTERS)].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER.types)], schema=_ANSWER)


def _with_answers(function: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, answers in zip(batch.column(0), batch.column(1).to_pylist()):
                parts = [(np.frombuffer(a["hashes"], np.uint64), np.frombuffer(a["times"], np.uint32)) for a in answers or ()]
                held = Held(
                    np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]]), np.concatenate([np.zeros(0, np.uint32), *[t for _, t in parts]])
                )
                yield from function(held, held)(iter(_unpacked(rows)))

    return run


def through_twice_seen(table: DataFrame, hashes: Callable, function: Callable, schema, *, expected: int, max_bytes: int, counted: bool = False) -> DataFrame:
    """``table`` through ``function(seen, counts)`` (batches -> batches of ``schema``).

    ``seen.holds`` is true for every hash that ``hashes`` (batches of ``table`` -> arrays) yields more than once, for nearly
    none of the others, and ``counts.of`` (where ``counted``) tells at least how often. Filters take a byte per expected hash. Up to ``max_bytes``
    they are broadcast and ``table`` is read where it is. Beyond, they stay on the executors: ``table`` is stored in blocks,
    each block asks the segments of its own hashes and is joined with their answers, so nothing grows on the driver or
    in a task, and a hash in a third of all rows is asked for once per block.
    """
    if expected <= max_bytes:
        seen = twice_seen(table, hashes, expected=expected, max_bytes=max_bytes)

        def often(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for found in hashes(batches):
                yield found[seen.holds(found)]

        counts = frequencies(table, often, expected=expected, max_counters=max_bytes // 4) if counted else None
        return table.mapInArrow(function(seen, counts), schema)
    segments = -(-8 * expected // SEGMENT_BITS)
    ask = "segment long, block long, hashes binary, times binary"
    blocks = stored(table.mapInArrow(_blocks, "block long, rows binary"), "hash-blocks")
    asked = stored(blocks.mapInArrow(_asking(hashes, segments), ask), "hash-questions")
    built = asked.repartition("segment").sortWithinPartitions("segment").mapInArrow(_building, ask)
    ordered = built.unionByName(asked).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("block"))
    answers = ordered.mapInArrow(_answering, "block long, hashes binary, times binary")
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("hashes", "times")).alias("answers"))
    return blocks.join(lists, "block", "left").select("rows", "answers").mapInArrow(_with_answers(function), schema)

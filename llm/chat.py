"""Render conversations for training and mark what the loss is taken on.

A conversation is rendered whole, encoded once, and the sorted spans of its assistant turns are intersected with
the sorted spans of its tokens by binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from llm.common import without
from llm.encoding import vocabulary

#: The text of a turn stands between two control strings, so that no token holds bytes of it and of anything else.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: ``<`` and ``|`` with backslashes between them; inside a text one backslash more is put there, so that no text
#: can hold a control string, and taken away again when the output is read.
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)
RENDERED = "formatted string, token_ids array<int>, loss_mask array<byte>, loss_spans array<struct<start int, stop int>>"
PARSED = "turns array<struct<role string, text string>>, loss_text string"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
#: Conversations of one batch, so that memory does not follow the size of Spark's batches.
BATCH = 100


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (code points) of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        begin = at + len(head)
        if role == "assistant" and body:
            spans.append((begin, begin + len(body)))
        parts += [head, body, END, "\n"]
        at = begin + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=1)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {name: len(ranks) + 1 + i for i, name in enumerate((START, SEP, END))}
    encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    lengths = np.zeros(len(ranks) + 4, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    for name, i in special.items():
        lengths[i] = len(name)
    return encoding, lengths


def decode(ids: np.ndarray, path: str) -> str:
    """The text of token ids that hold whole characters."""
    return _encoding(path)[0].decode_bytes(ids.tolist()).decode()


def masked_texts(ids: np.ndarray, mask: np.ndarray, path: str) -> list[str]:
    """The unescaped text of every run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape(decode(ids[a:b], path)) for a, b in zip(edges[::2], edges[1::2])]


def masked(formatted: str, spans: list[tuple[int, int]], path: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Token ids, their loss mask, and the stretches (code points) of the spans that lie under masked tokens."""
    encoding, lengths = _encoding(path)
    ids = np.array(encoding.encode(formatted, allowed_special="all"), np.int64)
    stops = np.cumsum(lengths[ids])
    starts = stops - lengths[ids]
    raw = formatted.encode()
    # byte place of every code point, as tokens are bytes and may split one
    places = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    places = np.append(places, len(raw))
    mask = np.zeros(len(ids), np.int8)
    under = []
    for begin, end in spans:
        first_byte, last_byte = places[begin], places[end]
        first = int(np.searchsorted(stops, first_byte, "right"))
        last = int(np.searchsorted(starts, last_byte, "left"))
        if first < last:
            mask[first:last] = 1
            low, high = max(first_byte, starts[first]), min(last_byte, stops[last - 1])
            under.append((int(np.searchsorted(places, low, "left")), int(np.searchsorted(places, high, "left"))))
    return ids, mask, under


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _rendered(batches: Iterator[pa.RecordBatch], vocabulary_file: str) -> Iterator[pa.RecordBatch]:
    path = vocabulary(vocabulary_file)
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.slice(at, BATCH)
            texts, spans = zip(*[render([(r["role"], r["text"]) for r in rows]) for rows in part.column(1).to_pylist()])
            ids, masks, under = zip(*[masked(t, s, path) for t, s in zip(texts, spans)])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.int8()),
                pa.array([[{"start": a, "stop": b} for a, b in u] for u in under], pa.list_(_SPAN)),
            ], ["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"])


def _parsed(batches: Iterator[pa.RecordBatch], vocabulary_file: str, at: list[int]) -> Iterator[pa.RecordBatch]:
    path = vocabulary(vocabulary_file)
    for batch in batches:
        for first in range(0, len(batch), BATCH):
            part = batch.slice(first, BATCH)
            text, ids, mask = (part.column(i) for i in at)
            turns = [[{"role": r, "text": x} for r, x in parse(t)] for t in text.to_pylist()]
            under = ["".join(masked_texts(np.asarray(i.values), np.asarray(m.values), path)) for i, m in zip(ids, mask)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(turns, _TURNS), pa.array(under, pa.string())], [*part.schema.names, "turns", "loss_text"])


def format_chats(conversations: DataFrame, *, vocabulary_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per conv_id: formatted, token_ids, loss_mask (1 for tokens that touch an assistant text), loss_spans
    (code points of ``formatted`` under the mask).

    Rows are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. A null text or role
    is empty; rows without conv_id form one conversation. Other columns are not read. An empty table gives no rows.
    A conversation is one row of the result, so it must fit a task.
    """
    empty = F.lit("")
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(partial(_rendered, vocabulary_file=vocabulary_file), f"conv_id {grouped.schema['conv_id'].dataType.simpleString()}, {RENDERED}")


def read_back(formatted: DataFrame, *, vocabulary_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """turns (role and text of each, parsed from the output) and loss_text added: what the masked token ids decode to, unescaped."""
    table = without(formatted, "turns", "loss_text")
    schema = StructType([*table.schema, *StructType.fromDDL(PARSED)])
    return table.mapInArrow(partial(_parsed, vocabulary_file=vocabulary_file, at=[table.columns.index(c) for c in ("formatted", "token_ids", "loss_mask")]), schema)


def turns_digest() -> Column:
    """Hex SHA-256 of role, line feed, text, line feed of each turn."""
    return F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256)

"""Token ids of a public byte-level BPE vocabulary, one white-space chunk at a time.

A single space between two visible characters always starts a new piece of the vocabulary's pattern, so the
chunks of a text can be encoded on their own and their ids kept. Texts with other runs of spaces, and texts
holding a special token's string, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points per step, so that one very long text needs bounded memory.
STEP = 1 << 18
#: Remembered chunks per process.
REMEMBERED = 300_000
_UNSAFE = re.compile(r"^ | $|\s |[ ]\s|<\|endoftext\|>")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ChunkEncoder:
    """Ids of ``tokenizers`` for a vocabulary file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = _ranked(path)
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.fast is None or "<|endoftext|>" in text:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or _UNSAFE.search(text):
            return self._whole(text)
        return b"".join(self._chunks(part, i > 0) for i, part in enumerate(_parts(text)))

    def _chunks(self, text: str, inner: bool) -> bytes:
        chunks = text.split(" ")
        keys = [" " + c for c in chunks]
        if not inner:
            keys[0] = chunks[0]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return b"".join([known[k] for k in keys])
        except KeyError:
            for k in keys:
                if k not in known:
                    known[k] = self._whole(k)
            return b"".join([known[k] for k in keys])


def _parts(text: str) -> Iterator[str]:
    """Stretches of about STEP code points, cut at single spaces (which are left out)."""
    at = 0
    while len(text) - at > STEP and (cut := _CUT.search(text, at + STEP)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def _ranked(path: str):
    """The same vocabulary for the faster library, if its ranks lie beside the file."""
    import base64
    import os

    beside = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(beside):
        return None
    import public_tokenizers
    import tiktoken

    with open(beside, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a full path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

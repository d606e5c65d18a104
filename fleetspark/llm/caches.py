"""What Python workers keep between tasks. Workers are reused, so an operator drops what others have left behind."""

from __future__ import annotations

import ctypes
from collections.abc import MutableMapping

import pyarrow as pa
import xxhash

_HELD: dict[str, list[MutableMapping]] = {}


def held(owner: str, cache: MutableMapping) -> MutableMapping:
    _HELD.setdefault(owner, []).append(cache)
    return cache


def only(owner: str) -> None:
    """Called by each task: empties the caches of all other owners in this worker and hands freed memory back to the machine."""
    for name, caches in _HELD.items():
        if name != owner:
            for c in caches:
                c.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = held("words", WordHashes())

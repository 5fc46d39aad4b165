"""Helpers for functions that read Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time in a task.  One longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield batch.slice(a, b - a)


def split_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    try:
        for batch in batches:
            yield from slices(batch, column, limit)
    finally:
        # a worker lives on for other tasks: it gives back what this one needed
        pa.default_memory_pool().release_unused()
        _trim()


@lru_cache
def _libc():
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def _trim() -> None:
    """Return freed heap to the system where the C library can."""
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; a null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without a detour over Python strings; a null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end of the last."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, n]


class Memo:
    """Values of the keys met lately, computed in bulk where they are missing.

    Two generations of half of ``limit`` each: when the young one is full, the old one goes and its keys that are
    met again come back.  Keys longer than ``longest`` are not kept.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], limit: int, longest: int):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def rows(self, rows: list[list[str]]) -> list[list[bytes]]:
        """The values of each row's keys: one look at each key, a second at those that were missing."""
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        get = self.young.get
        out = [list(map(get, keys)) for keys in rows]
        gaps = [(keys, found, [i for i, v in enumerate(found) if v is None]) for keys, found in zip(rows, out) if None in found]
        new = self.learn({keys[i] for keys, _, at in gaps for i in at})
        young = self.young
        for keys, found, at in gaps:
            for i in at:
                found[i] = young[keys[i]]
        for key in new:
            if len(key) > self.longest:
                del young[key]
        return out

    def learn(self, missing: set[str]) -> list[str]:
        """Put the values of ``missing`` into the young generation; the keys that had to be computed."""
        young, old = self.young, self.old
        young.update((k, old[k]) for k in missing if k in old)
        new = [k for k in missing if k not in young]
        young.update(zip(new, self.compute(new)))
        return new


#: Marks that often end a word.
TAILS = frozenset(".,;:!?")
_LATIN = chr(0x250)


def is_word(chunk: str) -> bool:
    """Whether a chunk is Latin letters only."""
    return chunk.isalpha() and (chunk.isascii() or max(chunk) < _LATIN)


def word_and_tail(chunk: str) -> bool:
    """Whether a chunk is Latin letters and one mark."""
    return chunk[-1:] in TAILS and is_word(chunk[:-1])

"""Vectorised text helpers that run inside Spark tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. They are found
on the UTF-8 bytes of an Arrow string column without making Python strings.
Work goes in slices of bounded size, so that one batch needs bounded memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: Text bytes that are hashed at a time (a longer document makes a slice of its own).
SLICE_BYTES = 1 << 20
#: Of these, bytes whose sums are held at a time (a longer word makes a part of its own).
HASHED_BYTES = 1 << 16

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), shifted by ``seed``."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept in tables of doubling length."""
    return _powers(base, 1 << max(12, int(n - 1).bit_length()))[:n]


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64), 17)
_WORD_BASE = 0xD6E8FEB86659FD93
_WORD_INVERSE = pow(_WORD_BASE, -1, 2**64)
_WINDOW_BASE = 0xA0761D6478BD642F
_WINDOW_INVERSE = pow(_WINDOW_BASE, -1, 2**64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], the same wherever the word stands."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASHED_BYTES, "right")))
        base, n = starts[lo], int(ends[hi - 1] - starts[lo])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        with np.errstate(over="ignore"):
            # Sums up to each byte: a word's part of them is moved back to its own first byte.
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[data[base : base + n]] * powers(_WORD_BASE, n), out=total[1:])
            out[lo:hi] = (total[e] - total[s]) * powers(_WORD_INVERSE, n)[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix64(out, 3)


_HELD: list[Callable[[], None]] = [_powers.cache_clear]
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def on_release(f: Callable[[], None]) -> Callable[[], None]:
    """Registers what a worker may keep between tasks; workers serve several operators, one after the other."""
    _HELD.append(f)
    return f


def release(keep: Callable[[], None] | None = None) -> None:
    """Frees what other operators' tasks have left in this worker, and gives freed memory back to the system."""
    for f in _HELD:
        if f is not keep:
            f()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task, keep: Callable[[], None] | None = None) -> Task:
    """The task, which begins and ends with ``release``: a worker that waits for its next task holds little."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        try:
            yield from task(batches)
        finally:
            release(keep)

    return run


def _mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 values of a byte."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), dtype=table.dtype)


class Words:
    """The words of some documents: hashes, byte spans, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, separators: np.ndarray = _SEPARATOR):
        self.raw = data
        if lower:
            data = _mapped(data, _LOWER)
        inside = _mapped(data, ~separators)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        inner = offsets[1:-1]
        inner = inner[(inner < len(data)) & (inner > 0)]
        start[inner] = inside[inner]  # a document's first byte never goes on with the last one's word
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each document, and the end
        self.hashes = span_hashes(data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, seed: int = 0) -> np.ndarray:
        """The hash of the ``size`` words from each word on; only windows inside one document mean anything."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mix64(self.hashes, seed) * powers(_WINDOW_BASE, n), out=total[1:])
            window = (total[size:] - total[:-size]) * powers(_WINDOW_INVERSE, n - size + 1)
        return mix64(window, seed + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and each row's offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.empty(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold about ``size`` bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1, and so on."""
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)

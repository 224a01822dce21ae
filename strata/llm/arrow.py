"""Arrow batches on the executors: slices of bounded text, and words with hashes by array operations."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_LIBC = None
if sys.platform == "linux":
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        _LIBC = ctypes.CDLL("libc.so.6")
        # freed arrays of 8 MB or more go back to the system at once
        _LIBC.mallopt(-3, 1 << 23)

#: Bytes of text that are worked on at once (one longer text is one slice).
SLICE = 2 << 20
#: Bytes that the hashing of words takes at once; longer texts are cut between words.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings, null taken as empty."""
    at = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return at.fill_null("")


def settle() -> None:
    """Gives unused memory of Arrow's pool back."""
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Gives all freed memory back, which takes longer."""
    settle()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def settled(work: Work) -> Work:
    """A function on batches that leaves no freed memory with its worker: idle workers, and those that do other work next, don't keep its peak."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def slices(column: pa.Array, most: int = SLICE, rows: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes, or of one row, and at most that many rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), start + rows, len(column))
        yield start, end
        start = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of the column, one after another, and where each begins (and the last ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    v = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    v[65:91] = v[97:123]  # A-Z count as a-z
    return v


_VALUES = _byte_values()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE * 2)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _cuts(data: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(blank[start:end])
            if len(gaps):
                end = start + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(blank[end:])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        yield start, end
        start = end


def word_spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes of several texts. blank: where bytes part words; by default the six blanks."""
    blank = _BLANK[data] if blank is None else blank
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(blank, out=inside[1:])
    first = inside[1:] & ~inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = inside[1:][edges]
    starts = np.flatnonzero(first)
    last = inside[1:].copy()
    last[:-1] &= blank[1:]
    last[edges - 1] = inside[1:][edges - 1]
    return starts, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words, A-Z taken as a-z."""
    blank = _BLANK[data] if blank is None else blank
    starts, ends = word_spans(data, bounds, blank)
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        for a, b in _cuts(data, blank):
            up = int(np.searchsorted(starts, b))
            if up == done:
                continue
            power, inverse = _powers(b - a + 1)
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_VALUES[data[a:b]] * power[: b - a], out=sums[1:])
            s, e = starts[done:up] - a, ends[done:up] - a
            hashes[done:up] = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            done = up
    return starts, ends, hashes


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, and once more at the end: how many words stand before it."""
    return np.searchsorted(starts, bounds)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of that many words, also those that cross from one text into the next."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = _mix(out + hashes[j : j + n]) * np.uint64(0x9E6C63D0876A9A35)
        return _mix(out)

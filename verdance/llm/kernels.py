"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one *slice*: a byte buffer holding some whole
documents and the int64 offsets between them.  Slices are cut by bytes, so the
memory of a kernel is bounded by ``SLICE_BYTES`` or by one document, whichever
is larger, and never by the number of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, U64), np.ones(0, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, mod 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory when its task ends.

    Python workers outlive tasks; without this each keeps the peak of all the
    tasks that it has run."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), in place on a copy."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole documents; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, where, data = text.buffers()
        offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(text):
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), len(text))
            yield (
                batch.slice(start, stop - start),
                data[offsets[start] : offsets[stop]],
                offsets[start : stop + 1] - offsets[start],
            )
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word.

    The third array has one more entry than there are documents.  ``space``
    flags the bytes that separate words."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word, the same wherever the word stands."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    values = (LOWER[data] if lower else data).astype(U64) + U64(1)
    np.cumsum(values * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive words of the slice."""
    if len(hashes) < width:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) - width + 1, U64)
    for k in range(width):
        total = (total + hashes[k : k + len(total)]) * U64(_BASE)
    return mix(total)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int = 5
) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of the slice.

    With 1 to ``width - 1`` words the whole sequence is the one shingle; with
    none the set is empty."""
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    runs = windows(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a) ^ U64(0x5851F42D4C957F2D * (b - a) & (2**64 - 1))
        else:
            yield np.zeros(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

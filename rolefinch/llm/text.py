"""Vectorised text kernels used inside Arrow tasks.

All of them work on chunks: a byte buffer with the offsets of the texts in it. A chunk holds about ``CHUNK``
bytes, or one longer text, so that memory does not grow with the number of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 500_000
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[LOWER]
_BASE, _BASE_INV = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and its inverses modulo 2^64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            t = np.full(max(n + 1, 1 << 16), b, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


class Chunk(NamedTuple):
    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # where each text's words begin, one more than there are texts


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi
    give_back()


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return memory that is free to the system: workers live on between tasks, and allocators keep what they freed."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until ``column`` has about ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words(c: Chunk, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text with 64-bit hashes (A-Z folded if ``lower``)."""
    n, m = len(c.buf), len(c.offsets) - 1
    word = ~space[c.buf]
    cut = np.zeros(n + 1, bool)
    cut[c.offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
        before |= cut[:-1]
        after |= cut[1:]
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    first = np.searchsorted(start, c.offsets)
    doc = np.repeat(np.arange(m), np.diff(first))
    return Words(start, end, doc, spans(c.buf, start, end, lower), first)


def running(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums of a polynomial modulo 2^64 over the bytes."""
    up, _ = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * up[: len(buf)], out=total[1:])
    return total


def spans_of(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from the running sums."""
    _, down = _power_tables(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return spans_of(running(buf, lower), start, end)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and where each text's begin; a shorter text is one shingle."""
    count = np.diff(w.first)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(per)])
    h = w.hash
    out = np.zeros(first[-1], np.uint64)
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xF1357AEA2E62A9C5) + h[j : len(h) - k + 1 + j]
        full = w.doc[: len(acc)] == w.doc[k - 1 :]
        long = np.repeat(count >= k, per)
        out[long] = mix(acc[full])
    for d in np.flatnonzero((count > 0) & (count < k)):
        acc = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for x in h[w.first[d] : w.first[d + 1]]:
                acc = mix(np.array([acc * np.uint64(0xF1357AEA2E62A9C5) + x]))[0]
        out[first[d]] = acc
    return out, first


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)

"""Vectorised scanning of Arrow string columns: word boundaries and 64-bit word hashes, a slice of rows at a time.

Words are maximal runs of bytes outside space and \\t..\\r; since these are ASCII, UTF-8 sequences are never cut.
A word's hash is a polynomial over mixed byte values modulo 2**64, so that all words of a slice come out of one
cumulative sum. Nulls have no words.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

SPACES = bytes([32, 9, 10, 11, 12, 13])
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64
_INVERSE = pow(_BASE, -1, _WORD)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Bytes, or words, whose products are held at a time; this bounds what scanning a text of any length needs beside it.
BLOCK = 1 << 17


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE_POWER = _powers(_BASE), _powers(_INVERSE)


def _polynomials(values: Callable[[int, int], np.ndarray], n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of v[i] * BASE**(i - s) over s <= i < e for each s and e of rising ``start`` and ``end``, where
    ``values(lo, hi)`` gives v[lo:hi] of n values. Done a block at a time, so that the power tables have a fixed size."""
    head, tail, scale = (np.zeros(len(start), dtype=np.uint64) for _ in range(3))
    carry, power, inverse = 0, 1, 1
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values(lo, hi) * _POWER[: hi - lo], out=total[1:])
        total = total * np.uint64(power) + np.uint64(carry)
        a, b = np.searchsorted(start, [lo, hi])
        at = start[a:b] - lo
        head[a:b], scale[a:b] = total[at], _INVERSE_POWER[at] * np.uint64(inverse)
        a, b = np.searchsorted(end, [lo + 1, hi + 1])
        tail[a:b] = total[end[a:b] - lo]
        carry, power, inverse = int(total[-1]), power * int(_POWER[-1]) % _WORD, inverse * int(_INVERSE_POWER[-1]) % _WORD
    return (tail - head) * scale


@dataclass
class Words:
    """The words of some rows, in order: hash, row (index in the slice), byte start and end in ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each row's first word; one entry more than rows
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
            column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def scan(column: pa.Array, lower: bool, breaks: bytes = SPACES) -> Words:
    data, offsets = buffers(column)
    n = len(data)
    gap = np.zeros(256, dtype=bool)
    gap[list(breaks)] = True
    inside = ~gap[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.diff(offsets) > 0
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del inside, begins, ends
    table = _LOWER if lower else _BYTES
    hashed = mix(_polynomials(lambda lo, hi: table[data[lo:hi]], n, start, end))
    row = np.searchsorted(offsets[:-1], start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)), side="left")
    return Words(hashed, row, start, end, first, data, offsets)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch holding about ``limit`` bytes of text; a longer text makes a slice of its own."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingles(words: Words, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the row of each; with ``short``, a row of fewer words is one window."""
    h, n = words.hash, len(words.hash)
    if n >= k:
        out = h[: n - k + 1].copy()
        for i in range(1, k):
            out = out * _MIX2 + h[i : n - k + 1 + i]
            out ^= out >> np.uint64(31)
        row = words.row[: n - k + 1]
        same = row == words.row[k - 1 :]
        out, row = mix(out[same]), row[same]
    else:
        out, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short:
        counts = words.counts()
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            more = np.zeros(len(few), dtype=np.uint64)
            for j, r in enumerate(few):
                own = np.full(1, counts[r], dtype=np.uint64)
                for x in h[words.first[r] : words.first[r + 1]]:
                    own = own * _MIX2 + x
                    own ^= own >> np.uint64(31)
                more[j] = own[0]
            at = np.searchsorted(row, few)
            out, row = np.insert(out, at, mix(more)), np.insert(row, at, few)
    return out, row


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, whatever rows they belong to."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    start = np.arange(len(h) - k + 1)
    return mix(_polynomials(lambda lo, hi: h[lo:hi], len(h), start, start + k))


def returned(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that gives its freed memory back when a partition ends, as workers outlive partitions."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return run


@lru_cache(maxsize=1)
def _trim():
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

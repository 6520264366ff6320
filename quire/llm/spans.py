"""Vectorised text primitives that the Arrow-batched operators share.

Texts of a batch are handled as one flat UTF-8 byte array.  A position-weighted prefix sum modulo 2**64
gives the hash of any byte span in constant time, so words, shingles and fixed-length strings cost a few
numpy passes a byte and no Python object each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_ROWS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, 256, dtype=np.uint64)

#: Bytes of one flat chunk; a single longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 18

_lower = np.arange(256, dtype=np.int64)
_lower[65:91] += 32
#: Random value of each byte; A-Z counts as a-z in the second.
BYTE_VALUE = _ROWS
LOWER_VALUE = _ROWS[_lower]
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on text with A-Z lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64 (kept between calls)."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        a, b = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INV, dtype=np.uint64)
        a[0] = b[0] = 1
        _powers, _inverse = np.cumprod(a), np.cumprod(b)
    return _powers[:n], _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit value."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Prefix:
    """Prefix sums of one flat byte array; ``of(start, end)`` hashes spans."""

    def __init__(self, data: np.ndarray, value: np.ndarray) -> None:
        self.power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(value[data] * self.power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        """Hashes of strings of one length, at some places, as ``fixed`` has them."""
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all strings of one length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else "", column.type))
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes; every row is in just one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more than rows)."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    m = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | edge[1:-1]
    end = m.copy()
    end[:-1] &= ~m[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63 - 1, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; runs across rows are among them, for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n] * _ODD[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _ODD[j]
    return mix(out)

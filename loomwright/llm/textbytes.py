"""Vectorised words of Arrow string columns: boundaries and 64-bit hashes over the UTF-8 bytes, without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20
#: Bytes of words between white space: everything but space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: A random number for each byte at each of a word's first places; a word's hash is the sum over its bytes, so it has no more structure than they have.
_PLACES = 64
_BYTES = np.random.default_rng(0x5EED).integers(0, 1 << 63, _PLACES * 256, dtype=np.uint64) * U64(2) + np.random.default_rng(0x5EEE).integers(0, 2, _PLACES * 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its rows (n + 1 offsets); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of some rows: byte bounds ``start`` and ``end``, a hash each, and ``row_at`` (row i has words row_at[i]:row_at[i + 1])."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE):
        self.raw, n = LOWER[raw], len(raw)
        inside = kind[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _BYTES[(place & (_PLACES - 1)) << 8 | self.raw[inside]]
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(U64))
        self.hash = mix(np.add.reduceat(value, first) + size.astype(U64)) if len(size) else np.zeros(0, U64)
        self.row_at = np.searchsorted(self.start, at)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row_at) - 1), np.diff(self.row_at))


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, one for each word that begins a run within the array."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, U64)
    for k in range(width):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
    return mix(out)


def words_of(column: pa.Array, kind: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) for pieces of a string column."""
    raw, at = column_bytes(column)
    for i, j in row_chunks(at):
        yield i, j, Words(raw[at[i] : at[j]], at[i : j + 1] - at[i], kind)

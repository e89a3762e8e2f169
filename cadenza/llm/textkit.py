"""Vectorised text kernels shared by the operators.

Every kernel works on a *block*: the UTF-8 bytes of some consecutive rows of an Arrow
column, with the rows' offsets.  Words, lines and their 64-bit hashes come out of a fixed
number of numpy passes over the bytes, so that no Python loop runs per word.

A string's hash is the sum of its 8-byte pieces, each mixed with a key of its place, and
of its length, mixed once more.  Two strings that were not made to collide share a hash
with a chance of about 2**-64, and n different ones hold some n * n / 2**65 such pairs; the
operators that call themselves exact are so up to that.  The function has no secret key.

A row is never split, so a block is as long as its longest text.  The kernels hold at most
about 60 bytes for each byte of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM_MULT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of `[^\x20\x09-\x0D]`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z is lowered.
WORD = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection of uint64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class PlaceKeys:
    """The key of each 8-byte piece of a string by its place, grown on demand."""

    keys = mix(np.arange(1, 65, dtype=np.uint64) * _STEP)

    @classmethod
    def of(cls, n: int) -> np.ndarray:
        if len(cls.keys) < n:
            cls.keys = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
        return cls.keys


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array that holds no null."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if at is not None and len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) with their offsets into the block's bytes; a row is never split."""
    column = as_text(column)
    at, data = raw(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b, at[a : b + 1] - at[a], data[at[a] : at[b]]
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    size = np.maximum(end - start, 0)
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    place = np.arange(total) - np.repeat(first, pieces)
    windows = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    spare = np.maximum(8 - (np.repeat(size, pieces) - 8 * place), 0).astype(np.uint64) * np.uint64(8)
    v = windows[np.repeat(start, pieces) + 8 * place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> spare)
    v = mix(v ^ PlaceKeys.of(int(pieces.max(initial=0)))[place])
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(pieces)
    if len(some):
        out[some] = np.add.reduceat(v, first[some])
    return mix(out + size.astype(np.uint64) * _STEP)


def spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that don't cross a row: start, end, and the index of each row's first run."""
    n = len(member)
    edge = np.zeros(n + 2, np.int8)
    edge[1:-1] = member
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before, here = edge[:-1], edge[1:]
    start = np.flatnonzero((here == 1) & ((before == 0) | cut))
    end = np.flatnonzero((before == 1) & ((here == 0) | cut))
    return start, end, np.searchsorted(start, at)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each item; the last n-1 items start none."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = h[:k] * GRAM_MULT[0]
    for i in range(1, n):
        out += mix(h[i : i + k] + GRAM_MULT[32 + i]) * GRAM_MULT[i]
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (length + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def unique_in_rows(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by row, then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]

"""Vectorised word hashing over Arrow string columns.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``. A word's 64-bit hash is a polynomial over a random value
per byte; a run of words gets a polynomial over word hashes. Prefix sums make both linear in the input, whatever the
length of the run. Work goes on in slices of about ``SLICE_BYTES`` so that memory stays bounded by a slice or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BYTE_BASE, _WORD_BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Slice(NamedTuple):
    """Some rows of a column. Word ``j`` of row ``r`` is entry ``first[r] + j`` of hashes, starts and ends."""

    row: int
    first: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The row, counted from ``row``, of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, lower: bool) -> Iterator[Slice]:
    """The words of a column, slice by slice. ``lower``: A to Z count as a to z."""
    offsets, data = texts(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        yield _slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, lower)
        a = b


def _slice(data: np.ndarray, offsets: np.ndarray, row: int, lower: bool) -> Slice:
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _byte_powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(_BYTES[data], up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0x9FB21C651E98DF25))
    return Slice(row, np.searchsorted(starts, offsets).astype(np.int64), hashes, data, starts, ends)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive words, one for each start; runs may cross rows."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _word_powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(hashes, up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + _U(k))


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the words from each start to each end."""
    n = len(hashes)
    up, down = _word_powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(hashes, up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def starts_inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which run starts leave ``k`` words inside their own row."""
    n = int(first[-1])
    inside = np.ones(max(0, n - k + 1), dtype=bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    return inside


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])

"""Words of Arrow text batches as numpy arrays: places, hashes, window hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials
over 64-bit words, taken from running sums, so that any word or window of words
costs two look-ups. Memory is bounded by the slices in which rows are handed on
and, for one very long text, by a few bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text handled together
_PART = 1 << 19  # bytes hashed together
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    """0th to (n-1)th power of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(_BASES[base], -1 if inverse else 1, 1 << 64)
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(b)
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 21:
            _powers[base, inverse] = have
    return have[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, False, len(values)), out=out[1:])
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text, at least one row each."""
    _, at = texts(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of consecutive texts: ``starts``, ``ends`` in ``data``; row r has words ``first[r]:first[r+1]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, rows = texts(column)
        self.data = data = _LOWER[data] if lower else data
        self.rows = rows
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        border = np.zeros(len(data) + 1, bool)
        border[rows] = True
        here = solid[1:-1]
        self.starts = np.flatnonzero(here & (~solid[:-2] | border[:-1]))
        self.ends = np.flatnonzero(here & (~solid[2:] | border[1:])) + 1
        self.first = np.searchsorted(self.starts, rows)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self)
        out = np.empty(n, np.uint64)
        k = 0
        while k < n:
            base = int(self.starts[k])
            j = max(k + 1, int(np.searchsorted(self.ends, base + _PART, side="right")))
            s, e = self.starts[k:j] - base, self.ends[k:j] - base
            sums = _sums(_BYTES[self.data[base : base + int(e[-1])]], 0)
            out[k:j] = (sums[e] - sums[s]) * _power(0, True, int(s[-1]) + 1)[s]
            out[k:j] += (e - s).astype(np.uint64)
            k = j
        return mix(out)

    def row_of(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


class Windows:
    """Hashes of runs of consecutive values; ``second`` gives an independent hash."""

    def __init__(self, values: np.ndarray, second: bool = False):
        self.base = 2 if second else 1
        self.sums = _sums(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if second else values, self.base)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        inverse = _power(self.base, True, int(starts.max()) + 1)
        return mix((self.sums[starts + length] - self.sums[starts]) * inverse[starts])

"""Vectorised text kernels over Arrow string columns: bytes, words, rolling hashes, sliding minima.

Everything works on the UTF-8 bytes of many documents at once, in pieces of bounded
size, so a Python worker's memory depends on the piece (or on one very long document),
not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18
#: Odd multipliers of the rolling hashes and their inverses modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_places = np.zeros(0, U64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        for name, step in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, step, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def fixed(self, length: int) -> np.ndarray:
        """Hash of the ``length`` values from each position on."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows of about ``limit`` bytes; a longer row comes alone."""
    raw, offs = string_parts(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes without ASCII white space), and the first word of each row (rows + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    heads = offs[:-1][offs[:-1] < n]
    opens[heads] = solid[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    closes[tails] = solid[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process: bytes are mixed with their places, so no pattern of bytes cancels out."""
    global _places
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    upto = np.cumsum(size)
    place = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
    longest = int(size.max())
    if len(_places) < longest:
        _places = mix64(np.arange(1, 2 * longest + 1024, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
    x = (BYTE_VALUE[LOWER] if lower else BYTE_VALUE)[raw[np.repeat(start, size) + place]] ^ _places[place]
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(32)
    sums = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=sums[1:])
    return mix64((sums[upto] - sums[upto - size]) + size.astype(U64) * U64(0xA0761D6478BD642F))


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned words as Arrow's signed longs."""
    return pa.array(x.view(np.int64))


def row_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``length`` units within rows: valid window starts, and the row of each."""
    counts = np.diff(first)
    fits = np.maximum(counts - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), fits)
    base = np.cumsum(fits) - fits
    at = np.arange(int(fits.sum())) - np.repeat(base, fits) + np.repeat(first[:-1], fits)
    return at, row

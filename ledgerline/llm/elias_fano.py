"""Monotone integer sequences in Elias-Fano form, over one flat buffer that can be memory-mapped."""

from __future__ import annotations

import json
import tempfile

import numpy as np

U64 = np.uint64
_LOW_MASK = [(1 << k) - 1 for k in range(65)]


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Bit position of the i-th set bit (from 0); ``before[w]`` counts set bits before word w."""
    w = np.searchsorted(before, i, "right") - 1
    w = np.minimum(w, len(words) - 1)
    rest = (i - before[w]).astype(np.int64)
    bits = words[w].copy()
    at = np.zeros(len(i), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(bits & U64(_LOW_MASK[step])).astype(np.int64)
        up = rest >= low
        rest -= np.where(up, low, 0)
        at += np.where(up, step, 0)
        bits = np.where(up, bits >> U64(step), bits)
    return w * 64 + at


class EliasFano:
    """Values are non-decreasing; ``get`` reads any of them, ``find`` searches within a range of places."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["shape"])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.ends = None
        size = max(0, len(self.low) - 7)
        self.window = np.ndarray((size,), "<u8", buffer=self.low, strides=(1,)) if size else None

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        high = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(high[-1]) if n else 0) // 64 + 2, U64)
        np.bitwise_or.at(words, high >> 6, U64(1) << (high & 63).astype(U64))
        raw = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        if low_bits:
            for lo in range(0, n, 1 << 16):  # whole bytes each time
                part = values[lo : lo + (1 << 16)]
                bits = ((part[:, None] >> np.arange(low_bits, dtype=U64)) & U64(1)).astype(np.uint8)
                packed = np.packbits(bits.reshape(-1), bitorder="little")
                raw[lo * low_bits // 8 : lo * low_bits // 8 + len(packed)] = packed
        count = np.bitwise_count(words).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)[:-1]])
        return {"shape": np.array([n, low_bits]), "low": raw, "high": words, "ones": ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        return ((self.window[at >> 3] >> (at & 7).astype(U64)) & U64(_LOW_MASK[self.low_bits])).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, i) - i
        return (high << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of the value x within [lo, hi), -1 where it isn't: the upper half names a bucket, the lower is searched."""
        x = np.asarray(x)
        bucket = (x >> U64(self.low_bits)).astype(np.int64) if x.dtype == U64 else x >> self.low_bits
        low = (x & U64(_LOW_MASK[self.low_bits])).astype(np.int64) if x.dtype == U64 else x & _LOW_MASK[self.low_bits]
        if self.ends is None:  # of all buckets, 4 bytes each: where the upper half's zeros stand
            gaps = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little") == 0)
            self.ends = (gaps - np.arange(len(gaps))).astype(np.int32)
        ok = bucket < len(self.ends) - 1
        b = np.where(ok, bucket, 0)
        end = self.ends[b].astype(np.int64)
        start = np.where(b > 0, self.ends[np.maximum(b - 1, 0)], 0).astype(np.int64)
        if lo is not None:
            start, end = np.maximum(start, lo), np.minimum(end, hi)
        left, right = start.copy(), np.where(ok, end, start)
        todo = np.flatnonzero(left < right)
        while len(todo):  # least place whose low half is at least the wanted one
            mid = (left[todo] + right[todo]) >> 1
            less = self._low(mid) < low[todo]
            left[todo[less]] = mid[less] + 1
            right[todo[~less]] = mid[~less]
            todo = todo[left[todo] < right[todo]]
        hit = ok & (left < end)
        hit[hit] = self._low(left[hit]) == low[hit]
        return np.where(hit, left, -1)


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, each at a multiple of 8 bytes, behind a JSON directory."""
    at, listing, body = 0, {}, []
    for name, x in parts.items():
        x = np.ascontiguousarray(x)
        listing[name] = [x.dtype.str, len(x), at]
        raw = x.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps(listing).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(body)


def memory_map(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of ``pack``, mapped from a file without a name: gone with the process, shared by the page cache."""
    file = tempfile.TemporaryFile()  # noqa: SIM115
    file.write(data)
    file.flush()
    whole = np.memmap(file, np.uint8, "r")
    size = int(whole[:8].view("<u8")[0])
    out = {}
    for name, (kind, n, at) in json.loads(bytes(whole[8 : 8 + size])).items():
        start = 8 + size + at
        out[name] = np.asarray(whole[start : start + n * np.dtype(kind).itemsize]).view(kind)
    return out

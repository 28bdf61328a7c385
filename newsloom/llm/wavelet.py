"""Wavelet matrix: a sequence of integers as bit-planes with rank and select, numpy only."""

from __future__ import annotations

import numpy as np

BLOCK = 512


class WaveletMatrix:
    """Planes from the highest bit down. After each plane, values with a 0 bit go to the front, those with a 1 behind, in order."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        width = width or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for k in range(width - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            planes.append(packed)
            zeros.append(len(ids) - int(one.sum()))
            ranks.append(np.r_[0, np.cumsum(np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32))].astype(np.uint32))
            ids = np.concatenate([np.compress(~one, ids), np.compress(one, ids)])
        return cls(len(ids), planes, zeros, ranks)

    def _bits(self, k: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[k][i >> 3] >> (i & 7).astype(np.uint8)) & np.uint8(1)

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place: the block's sum, whole bytes, then the rest of one byte."""
        i = np.asarray(i, np.int64)
        out = self.ranks[k][i // BLOCK].astype(np.int64)
        plane = np.r_[self.planes[k], np.zeros(BLOCK // 8 + 1, np.uint8)]
        at = i // BLOCK * (BLOCK // 8)
        for step in range(BLOCK // 8):
            byte = plane[at + step]
            left = np.clip(i - (at + step) * 8, 0, 8)
            out += np.bitwise_count(byte & ((1 << left) - 1).astype(np.uint8))
        return out

    def access(self, places) -> np.ndarray:
        """The values at the given places."""
        i = np.asarray(places, np.int64)
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.planes)):
            bit = self._bits(k, i)
            ones = self._ones(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            out = out << 1 | bit
        return out

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        width = len(self.planes)
        if value < 0 or value >> width:
            return 0, 0
        for k in range(width):
            a, b = self._ones(k, np.array([low, high])).tolist()
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if value >> (width - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often the value occurs in places low to high - 1."""
        high = self.n if high is None else min(high, self.n)
        a, b = self._range(value, min(max(low, 0), high), high)
        return b - a

    def _select(self, k: int, bit: int, i: np.ndarray) -> np.ndarray:
        """The place of the i-th (from 0) 0 or 1 of plane k: its block by the sums before blocks, then within the block."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, i, "right") - 1
        out = np.empty(len(i), np.int64)
        plane = np.r_[self.planes[k], np.zeros(BLOCK // 8, np.uint8)]
        for at in range(0, len(i), 4096):
            b = block[at : at + 4096]
            bits = np.unpackbits(plane[(b * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)], axis=1, bitorder="little") == bit
            nth = np.cumsum(bits, axis=1, dtype=np.int16) > (i[at : at + 4096] - before[b])[:, None]
            out[at : at + 4096] = b * BLOCK + nth.argmax(1)
        return out

    def occurrences(self, value: int) -> np.ndarray:
        """All places of the value, ascending: select on each plane, from the last up."""
        a, b = self._range(value, 0, self.n)
        i = np.arange(a, b)
        for k in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence: undo the partitions from the last plane up."""
        width = len(self.planes)
        ids = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for k in range(width - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(ids)
            back[np.flatnonzero(~one)] = ids[: self.zeros[k]]
            back[np.flatnonzero(one)] = ids[self.zeros[k] :] | ids.dtype.type(1 << (width - 1 - k))
            ids = back
        return ids.astype(np.uint32)

    def to_record(self) -> dict:
        return {"n": self.n, "planes": [p.tobytes() for p in self.planes], "zeros": list(self.zeros), "ranks": [r.tobytes() for r in self.ranks]}

    @classmethod
    def from_record(cls, r: dict) -> WaveletMatrix:
        return cls(r["n"], [np.frombuffer(p, np.uint8) for p in r["planes"]], r["zeros"], [np.frombuffer(x, np.uint32) for x in r["ranks"]])

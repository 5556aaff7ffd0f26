"""Elias-Fano coding of sorted integers with a select structure.

n values below u take n * (2 + log2(u / n)) bits: the low bits in a packed
array, the high bits as gaps in a bit vector. select(i) starts at a sampled
position and counts bits from there.
"""

from __future__ import annotations

import numpy as np

#: Every so many ones the place of a one is stored.
SAMPLE = 512


def encode(values: np.ndarray) -> dict:
    """Parts of the code: n, low_bits, and the bytes of low, high and samples."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    width = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
    low = v & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n) if width < 64 else np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=bool)
    high[ones] = True
    return {"n": n, "low_bits": width, "low": np.packbits(bits.reshape(-1), bitorder="little").tobytes(), "high": np.packbits(high, bitorder="little").tobytes(), "samples": ones[::SAMPLE].astype("<u4" if n == 0 or ones[-1] < 1 << 32 else "<u8").tobytes(), "wide": bool(n and ones[-1] >= 1 << 32)}


class Reader:
    """Random access to the values of a code."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes, wide: bool = False) -> None:
        self.n, self.width = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u8" if wide else "<u4")

    def __len__(self) -> int:
        return self.n

    def range(self, start: int, stop: int) -> np.ndarray:
        """Values number start to stop - 1; those from 2**63 on come out negative."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        first = start // SAMPLE
        last = -(-stop // SAMPLE)
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        skip = start - first * SAMPLE + np.searchsorted(ones, int(self.samples[first]))
        top = ones[skip : skip + stop - start] - np.arange(start, stop)
        if not self.width:
            return top
        b0, b1 = start * self.width, stop * self.width
        bits = np.unpackbits(self.low[b0 // 8 : -(-b1 // 8)], bitorder="little")[b0 % 8 :][: b1 - b0]
        low = bits.reshape(-1, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return (top << self.width) | low

    def select(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

"""Rising numbers in near-minimal space with direct access (Elias-Fano)."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256  # the bit position of every 256th number is kept for select
_HEAD = struct.Struct("<QQB")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values) -> bytes:
    """Non-falling non-negative numbers. Each is split: the low bits are stored as they are,
    the high part in unary, about two bits a number."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0))
    return b"".join([
        _HEAD.pack(n, len(high), low), ones[::SAMPLE].astype("<u4").tobytes(),
        np.packbits(high, bitorder="little").tobytes(), np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
    ])


class EliasFano:
    def __init__(self, data: bytes):
        self.n, n_high, self.low = _HEAD.unpack_from(data)
        at = _HEAD.size
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        self.high = np.frombuffer(data, np.uint8, -(-n_high // 8), at)
        at += len(self.high)
        self.bits = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Number ``i``, from the nearest sample on, reading only the bytes between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start // 8
        here = int(self.high[byte]) >> (start % 8) << (start % 8)
        while _ONES[here] <= left:
            left -= int(_ONES[here])
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        value = (byte * 8 + (here & -here).bit_length() - 1 - i) << self.low
        for k in range(self.low):
            p = i * self.low + k
            value |= (int(self.bits[p // 8]) >> (p % 8) & 1) << k
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low
        if self.low:
            bits = np.unpackbits(self.bits, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            out += bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out

"""Elias-Fano coding of ascending numbers, with selection.

Of n numbers up to u each keeps its lowest floor(log2(u / n)) bits packed as they
are; what is above is coded as a row of bits in which the i-th one stands at
``i + (number >> low)``. That is at most two bits a number and the low bits, however
large u is. To select a number, only a stretch of that row is read: the place of every
256th one is kept in four bytes (eight beyond 2**32 bits).
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
_HEAD = struct.Struct("<4sBBxxQQQ")  # magic, low bits, bytes of a sample, numbers, upper bound, bits of the upper row
_MAGIC = b"EFn1"
_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The lowest bits of values, one after the other; a block of numbers at a time."""
    if not bits:
        return b""
    places, out = np.arange(bits, dtype=np.uint64), []
    for k in range(0, len(values), 1 << 16):  # a multiple of eight, so blocks end at whole bytes
        block = values[k : k + (1 << 16)].astype(np.uint64)
        out.append(np.packbits(((block[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def encoded(values: np.ndarray) -> bytes:
    """values: ascending numbers, equal ones allowed, none negative."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    length = n + (top >> low) + 1
    ones = (values.astype(np.int64) >> low) + np.arange(n, dtype=np.int64)
    upper = np.zeros(-(-length // 8), np.uint8)
    np.bitwise_or.at(upper, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
    wide = 4 if length < 1 << 32 else 8
    samples = ones[::EVERY].astype(f"<u{wide}").tobytes()
    return _HEAD.pack(_MAGIC, low, wide, n, top, length) + samples + upper.tobytes() + _packed(values, low)


class EliasFano:
    """Numbers in their code; ``data`` is what ``encoded`` gave."""

    def __init__(self, data: bytes):
        magic, self.low, wide, self.n, self.top, length = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano code")
        samples = -(-self.n // EVERY)
        at = _HEAD.size
        self.samples = np.frombuffer(data, f"<u{wide}", samples, at)
        at += samples * wide
        self.upper = np.frombuffer(data, np.uint8, -(-length // 8), at)
        at += len(self.upper)
        self.lower = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)

    def __len__(self) -> int:
        return self.n

    def _low_bits(self, i: int, j: int) -> np.ndarray:
        if not self.low:
            return np.zeros(j - i, np.int64)
        a, b = i * self.low, j * self.low
        bits = np.unpackbits(self.lower[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 :][: b - a]
        return bits.reshape(j - i, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def _place(self, i: int) -> int:
        """Where the i-th one of the upper row stands."""
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at >> 3
        left += int(_ONES[int(self.upper[byte]) & ((1 << (at & 7)) - 1)])  # ones of the byte before the sample
        while True:
            sums = np.cumsum(_ONES[self.upper[byte : byte + 4096]], dtype=np.int64)
            if sums[-1] > left:
                k = int(np.searchsorted(sums, left, "right"))
                left -= int(sums[k - 1]) if k else 0
                bits = np.flatnonzero(np.unpackbits(self.upper[byte + k : byte + k + 1], bitorder="little"))
                return (byte + k) * 8 + int(bits[left])
            left -= int(sums[-1])
            byte += len(sums)

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self._place(i) - i) << self.low) | int(self._low_bits(i, i + 1)[0])

    def slice(self, i: int, j: int) -> np.ndarray:
        """The numbers from i to j - 1."""
        if i >= j:
            return np.zeros(0, np.int64)
        a, b = self._place(i), self._place(j - 1)
        bits = np.unpackbits(self.upper[a >> 3 : (b >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits) + (a >> 3) * 8
        ones = ones[(ones >= a) & (ones <= b)]
        return ((ones - np.arange(i, j)) << self.low) | self._low_bits(i, j)

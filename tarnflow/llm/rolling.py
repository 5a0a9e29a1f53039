"""Hashes of many substrings of a byte buffer at once.

A substring's hash is a polynomial over numbers drawn for each byte value, modulo 2**64, mixed at the
end. With sums of the terms from the buffer's start, the hash of any substring is one difference
times a power of the base's inverse.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_numbers(seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


class Powers:
    """Powers of the base and its inverse, as many as were ever wanted."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            ones = np.ones(n + 1, np.uint64)
            ones[1:] = np.uint64(BASE)
            self.up = np.multiply.accumulate(ones)
            ones[1:] = np.uint64(INVERSE)
            self.down = np.multiply.accumulate(ones)
        return self.up, self.down


class Rolling:
    """Substring hashes of one buffer."""

    def __init__(self, buf: np.ndarray, powers: Powers, numbers: np.ndarray):
        up, self.down = powers.of(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(numbers[buf] * up[: len(buf)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end; not mixed with their number."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

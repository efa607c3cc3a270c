"""Words of whole texts as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

#: A word is a run of bytes other than these (space and 0x09 to 0x0D).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Splits UTF-8 texts into words and hashes them; A-Z can be lower-cased on the way."""

    def __init__(self, lower: bool = True) -> None:
        self.white = np.zeros(256, dtype=bool)
        self.white[list(WHITE)] = True
        self.value = np.arange(256, dtype=np.uint64)
        if lower:
            self.value[65:91] += U64(32)
        self.value += U64(1)
        self.inverse = U64(pow(BASE, -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 1 << 12)
            steps = np.full(size, U64(BASE))
            steps[0] = 1
            self.power = np.cumprod(steps)
            steps[1:] = self.inverse
            self.back = np.cumprod(steps)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end bytes of each word of a uint8 array."""
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~self.white[data]
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.back[starts])

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint64)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts, ends = self.spans(data)
        return self.hashes(data, starts, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of a length; of shorter texts the whole sequence."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, U64(n))
    for i in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return np.unique(out)

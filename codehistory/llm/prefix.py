"""Prefix polynomial hashes: equality of any two spans, and longest common extensions by binary search.

A sequence of numbers is hashed modulo two primes below 2^31 as sum of value * base^place.
Prefix sums of the terms answer any span in constant time. Powers come from two tables of
65,536 places, so nothing but the sums themselves grows with the sequence.
"""

from __future__ import annotations

import numpy as np

PRIMES = (2147483647, 2147483629)
BASES = (1290437503, 728194627)
_BLOCK = 1 << 16


def _table(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1)."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class _Powers:
    """Powers of a base modulo a prime at any places."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.prime = base, prime
        self.low = _table(base, prime, _BLOCK)
        self.high = np.ones(1, np.uint64)

    def blocks(self, n: int) -> np.ndarray:
        """Powers at the first place of n blocks."""
        if n > len(self.high):
            self.high = _table(pow(self.base, _BLOCK, self.prime), self.prime, max(n, 2 * len(self.high)))
        return self.high[:n]

    def __call__(self, at: np.ndarray) -> np.ndarray:
        high = self.blocks((int(at.max()) >> 16) + 1) if len(at) else self.high
        return self.low[at & (_BLOCK - 1)] * high[at >> 16] % np.uint64(self.prime)


_UP = tuple(_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))
_DOWN = tuple(_Powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True))


class _Sums:
    """Prefix sums modulo one prime: within blocks of places, and of the blocks."""

    def __init__(self, values: np.ndarray, which: int) -> None:
        p = np.uint64(PRIMES[which])
        self.up, self.prime, n = _UP[which], p, len(values)
        self.part = np.zeros(n + 1, np.uint64)
        totals = np.zeros(n // _BLOCK + 1, np.uint64)
        # terms of small numbers can be summed over a block before they are reduced
        small = n > 0 and int(values.max()) < _BLOCK
        for k in range(0, n, _BLOCK):
            v = values[k : k + _BLOCK].astype(np.uint64)
            terms = v * self.up.low[: len(v)] if small else v % p * self.up.low[: len(v)] % p
            np.cumsum(terms, out=self.part[k + 1 : k + 1 + len(v)])
            totals[k // _BLOCK] = self.part[k + len(v)] % p
        self.base = np.append(np.uint64(0), np.cumsum(totals * self.up.blocks(len(totals)) % p) % p)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the first `at` numbers."""
        block = np.maximum(at - 1, 0) >> 16
        return (self.base[block] + self.part[at] % self.prime * self.up.blocks(len(self.base))[block]) % self.prime

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """sum of value * base^place over [lo, hi), places counted from the begin of the sequence."""
        return (self.upto(hi) + self.prime - self.upto(lo)) % self.prime


class Prefix:
    """Prefix hashes of a sequence of numbers of at most 63 bits."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.sums = len(values), tuple(_Sums(values, i) for i in range(len(PRIMES)))

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A number below 2^62 for each [lo, hi), the same wherever equal numbers stand."""
        a, b = (s.span(lo, hi) * _DOWN[i](lo) % s.prime for i, s in enumerate(self.sums))
        return a << np.uint64(31) | b

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n numbers from a and from b on are the same, for each a <= b."""
        out = np.ones(len(a), bool)
        for s in self.sums:
            out &= s.span(a, a + n) * s.up(b - a) % s.prime == s.span(b, b + n)
        return out

    def _longest(self, holds, most: np.ndarray) -> np.ndarray:
        """The largest n up to `most` for which holds(n), given that what holds for n holds for less."""
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            yes = holds(mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers from a and from b on are the same, up to `most`, for each a <= b."""
        return self._longest(lambda n: self.equal(a, b, n), most)

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before a and before b are the same, up to `most`, for each a <= b."""
        return self._longest(lambda n: self.equal(a - n, b - n, n), most)

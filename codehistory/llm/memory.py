"""What a Python worker remembers of strings that it has cut into ids."""

from __future__ import annotations

import numpy as np


class Memory:
    """Ids of strings seen before, in one pool. When too many are held, those seen least often go."""

    def __init__(self, most: int) -> None:
        self.most, self.place = most, {}
        self.begin, self.size, self.seen = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def append(self, ids: np.ndarray) -> int:
        """Put ids at the end of the pool; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(2 * self.used - at, np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def add(self, names: list[str], begin: np.ndarray, size: np.ndarray) -> None:
        a, b = len(self.place), len(self.place) + len(names)
        if b > len(self.begin):
            self.begin, self.size, self.seen = (np.concatenate([x[:a], np.zeros(2 * b - a, np.int64)]) for x in (self.begin, self.size, self.seen))
        self.begin[a:b], self.size[a:b], self.seen[a:b] = begin, size, 1
        self.place.update(zip(names, range(a, b), strict=True))

    def tidy(self) -> None:
        n = len(self.place)
        if n <= self.most:
            return
        least = int(np.partition(self.seen[:n], n - self.most // 2)[n - self.most // 2]) + 1
        stay = np.flatnonzero(self.seen[:n] >= least)
        size = self.size[stay]
        ids = gather(self.pool, self.begin[stay], size)
        names = list(self.place)
        names = [names[i] for i in stay.tolist()]
        self.place, self.used = {}, 0
        self.append(ids)
        self.add(names, np.cumsum(size) - size, size)


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[begin:begin + size] of each pair, one after the other."""
    to = np.cumsum(size)
    return pool[np.repeat(begin - (to - size), size) + np.arange(int(size.sum()))]

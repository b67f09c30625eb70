"""Vectorised words of a batch of texts.

Operators that look at every word of every document share this module. A batch of texts is
one byte buffer with document offsets; words are found by a byte table, so the cost is a
few passes over the bytes and no Python object is made per word. UTF-8 keeps every byte of
a non-ASCII character at 0x80 or above, so byte tables are exact for classes that only
split on ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on; longer single texts form a step alone.
STEP_BYTES = 2 << 20
_HASH_STEP = 1 << 18

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words split at space and 0x09-0x0D.
NOT_WHITE = ~_WHITE
#: Words of digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
#: Independent random numbers for each place in a word, up to PLACES, and byte; two tables give two independent hashes.
PLACES = 64
_TABLES = tuple(_rng.integers(0, 2**64, PLACES * 256, dtype=np.uint64) for _ in range(2))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, m), _powers(self.inverse, m)
        return self.up, self.down


_WORDS = _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become unrelated numbers."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and don't overlap.

    A byte adds the random number of its place and value. Beyond PLACES bytes the numbers
    repeat, times a random odd number for each stretch, so no structure of a long word cancels.
    """
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + _HASH_STEP)))
        lo, hi = int(start[a]), int(end[b - 1])
        s, e = start[a:b] - lo, end[a:b] - lo
        place = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
        values = _TABLES[table][(place & (PLACES - 1)) << 8 | buf[lo:hi]]
        if int((e - s).max()) > PLACES:
            stretch = place // PLACES
            factor = mix(np.arange(int(stretch.max()) + 1, dtype=np.uint64), 91 + table) | np.uint64(1)
            factor[0] = 1
            values *= factor[stretch]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        out[a:b] = total[e] - total[s]
        a = b
    return mix(out, table)


@dataclass
class Words:
    """Words of a batch: byte spans, 64-bit hashes, and first[i]:first[i+1] as those of text i."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = span_hash(self.buf, self.start, self.end)
        return self._hash

    @property
    def other(self) -> np.ndarray:
        """Hashes that are independent of `hash`."""
        if not hasattr(self, "_other"):
            self._other = span_hash(self.buf, self.start, self.end, 1)
        return self._other

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def find(buf: np.ndarray, off: np.ndarray, keep: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    """The words of a batch under a byte table, after lowering A-Z if asked."""
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = keep[buf]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: max(n - 1, 0)]
    edge = off[:-1][off[:-1] < n]
    begins[edge] = inside[edge]
    ends = inside[:n] & ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(buf, off, start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


def of(texts: pa.Array, keep: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    return find(*buffer(texts), keep, lower)


def window_hash(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of h[i:i+k] for each i; the last k-1 positions have no window."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xA0761D6478BD642F + 2 * salt)
    out = h[k - 1 : k - 1 + n].copy()
    for j in range(k - 2, -1, -1):
        out *= base
        out += h[j : j + n]
    return mix(out, salt + k)


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Which positions have k words of one text from them on."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= k


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of h[lo:hi] for each pair."""
    up, down = _WORDS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo], salt)


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass a number of bytes, one row at least."""
    for batch in batches:
        texts, a = batch.column(column), 0
        if not batch.num_rows:
            continue
        _, off = buffer(texts)
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b
        # what Arrow holds of past batches goes back, as a worker lives through many stages
        pa.default_memory_pool().release_unused()


def strings(w: Words, at: np.ndarray) -> list[bytes]:
    """The bytes of the words at these indexes."""
    raw = w.buf.tobytes()
    return [raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]


def joined(w: Words, at: np.ndarray) -> bytes:
    """The words at these ascending indexes of one text, joined by one space."""
    if not len(at):
        return b""
    lo = int(w.start[at[0]])
    hi = int(w.end[at[-1]])
    keep = np.zeros(hi - lo + 1, np.int8)
    np.add.at(keep, w.start[at] - lo, 1)
    np.add.at(keep, w.end[at] - lo, -1)
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    n = w.end[at] - w.start[at]
    out = np.full(int(n.sum()) + len(at), 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[np.cumsum(n + 1) - 1] = False
    out[place] = w.buf[lo:hi][inside]
    return out[:-1].tobytes()


def joined_texts(w: Words, keep: np.ndarray = NOT_WHITE) -> list[bytes]:
    """The words of each text joined by one space, for the table that found them."""
    n = w.end - w.start
    out = np.full(int(n.sum()) + len(n), 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[np.cumsum(n + 1) - 1] = False
    out[place] = w.buf[keep[w.buf]]
    edge = np.append(0, np.cumsum(n + 1))[w.first].tolist()
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]

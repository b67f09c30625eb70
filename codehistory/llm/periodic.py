"""Runs: stretches of words that repeat with a period, found on tiles of a document and stitched.

Periods are dealt into octaves [P, 2P). For each octave a document is cut into tiles that
overlap by 4P words, so every two periods of a run lie whole in some tile, and each tile is
solved without the others. In a tile, words at multiples of P are boundaries: a run of an
octave holds a boundary b with b + period still in it. Two Z-functions at b, how far the
words from b and from b + p on agree and how far those before them do, tell whether a run of
period p passes b: they must add up to p at least. Values below P/2 cannot be half of that,
so only places where P/2 words agree get one, by prefix hashes; what they find is compared
word by word. Fragments (document, period, begin, end) of tiles are shuffled by document and
period, and those that overlap by a period are one run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import stored
from .prefix import Prefix

#: Words of a tile that no other tile has, at least; tiles of long periods grow with the period.
TILE = 4096
#: Words that are solved together.
GROUP = 1 << 19
#: Periods below this are compared place by place.
SMALL = 8

FOUND = "row long, doc_id long, n_words long, words binary, collapsed_sha256 string, period array<int>, begin array<int>, finish array<int>"


def _numbers(w: W.Words) -> np.ndarray:
    """The same number for the same word, in a batch."""
    off = np.append(0, np.cumsum(w.end - w.start)).astype(np.int64)
    data = np.ascontiguousarray(w.buf[W.NOT_WHITE[w.buf]])
    held = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return held.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _tiles(first: np.ndarray, octave: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of tiles of the texts that can hold a run of an octave; they overlap by the shortest run of any of its periods, at least."""
    n = np.diff(first)
    can = np.flatnonzero(n >= max(least, 2 * octave if octave >= SMALL else 2))
    over = max(least, 4 * octave)
    own = max(over, TILE)
    count = np.maximum(1, -((over - n[can]) // own))
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(first[can], count) + at * own
    return begin, np.minimum(begin + own + over, np.repeat(first[can + 1], count))


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of true of a length at least."""
    other = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    k = np.flatnonzero(np.diff(other) > least)
    return other[k] + 1, other[k + 1]


def _need(period: int, least: int) -> int:
    """How many places must agree with those a period later."""
    return max(least, 2 * period) - period


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + [n] * (n > 1)


def _smallest(x: np.ndarray, s: int, p: int) -> bool:
    """Whether two periods from s on have no smaller period; such a period would divide p."""
    return not any(np.array_equal(x[s : s + 2 * p - p // r], x[s + p // r : s + 2 * p]) for r in _primes(p))


def _short(x: np.ndarray, edge: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs (begin, end, period) of periods below SMALL in tiles x[edge[i]:edge[i+1]]."""
    out = []
    for p in range(1, SMALL):
        if len(x) <= p:
            break
        same = x[:-p] == x[p:]
        for k in range(1, p + 1):
            at = edge[1:-1] - k
            same[at[at >= 0]] = False
        s, e = _stretches(same, _need(p, least))
        out += [(a, b + p, p) for a, b in zip(s.tolist(), e.tolist(), strict=True) if _smallest(x, a, p)]
    return out


def _passing(x: np.ndarray, edge: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries b and periods p for which half an octave of words from b and b + p on, or before them, agree."""
    m = octave // 2
    up, down = W._WORDS.get(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(W.mix(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    h = (total[m:] - total[:-m]) * down[: len(x) - m + 1]
    b, p = [], []
    for before in (0, m):
        padded = np.zeros((len(h) + before) // octave * octave + 2 * octave, np.uint64)
        padded[before : before + len(h)] = h
        grid = padded.reshape(-1, octave)
        row, column = np.nonzero(grid[1:] == grid[:-1, :1])
        lo, hi = row * octave - before, (row + 1) * octave + column + m - before
        good = (lo >= 0) & (hi <= len(x))
        row, column, lo, hi = row[good], column[good], lo[good], hi[good]
        good = np.searchsorted(edge, lo, side="right") == np.searchsorted(edge, hi - 1, side="right")
        b.append(row[good] * octave)
        p.append(octave + column[good])
    both = np.unique(np.concatenate(b) << np.int64(32) | np.concatenate(p))
    return both >> np.int64(32), both & np.int64(0xFFFFFFFF)


def _long(x: np.ndarray, edge: np.ndarray, octave: int, least: int, known) -> list[tuple[int, int, int]]:
    """Runs (begin, end, period) of one octave in tiles x[edge[i]:edge[i+1]]; known(b, e) says that x[b:e] has a period of half an octave at most."""
    if len(x) < 2 * octave:
        return []
    b, p = _passing(x, edge, octave)
    # inside a run of a short period all that agrees belongs to that run
    m = octave // 2
    news = ~(known(b, b + p + m) | known(b - m, b + p))
    b, p = b[news], p[news]
    if not len(b):
        return []
    # prefix hashes of those tiles only that have something to extend
    tile = np.searchsorted(edge, b, side="right") - 1
    used = np.unique(tile)
    size = edge[used + 1] - edge[used]
    at = np.append(0, np.cumsum(size))
    hashes = Prefix(W.mix(np.concatenate([x[edge[t] : edge[t + 1]] for t in used.tolist()]).astype(np.uint64) + np.uint64(1)) >> np.uint64(1))
    place = np.searchsorted(used, tile)
    local = at[place] + b - edge[tile]
    after = hashes.forward(local, local + p, edge[tile + 1] - b - p)
    ahead = hashes.backward(local, local + p, b - edge[tile])
    long_ = after + ahead >= np.maximum(least, 2 * p) - p
    found = sorted(set(zip((b - ahead)[long_].tolist(), (b + p + after)[long_].tolist(), p[long_].tolist(), tile[long_].tolist(), strict=True)))
    out: set[tuple[int, int, int]] = set()
    for s, e, q, t in found:
        if np.array_equal(x[s : e - q], x[s + q : e]):
            stretches = [(s, e)]
        else:  # hashes of different words were the same: compare all places of the tile
            lo, hi = int(edge[t]), int(edge[t + 1])
            u, v = _stretches(x[lo : hi - q] == x[lo + q : hi], _need(q, least))
            stretches = list(zip((u + lo).tolist(), (v + lo + q).tolist(), strict=True))
        out.update((u, v, q) for u, v in stretches if _smallest(x, u, q))
    return list(out)


def _stitched(runs: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) with those of one period that overlap by it made one."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    wide = np.int64(1) << np.int64(40)
    end = np.maximum.accumulate(runs[:, 1] + runs[:, 2] * wide) - runs[:, 2] * wide
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 2] != runs[:-1, 2]) | (runs[1:, 0] > end[:-1] - runs[1:, 2])
    at = np.flatnonzero(new)
    return np.column_stack([runs[at, 0], end[np.append(at[1:], len(runs)) - 1], runs[at, 2]])


class _Known:
    """Whether spans lie in a run with a period up to a limit."""

    def __init__(self, runs: np.ndarray, most: int) -> None:
        runs = runs[runs[:, 2] <= most]
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        self.begin, self.reach = runs[:, 0], np.maximum.accumulate(runs[:, 1]) if len(runs) else runs[:, 1]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.begin, lo, side="right") - 1
        return (k >= 0) & (self.reach[np.maximum(k, 0)] >= hi) if len(self.begin) else np.zeros(len(lo), bool)


def solve(x: np.ndarray, first: np.ndarray, least: int = 12) -> np.ndarray:
    """Fragments (begin, end, period) of the runs of texts x[first[i]:first[i+1]], tile by tile; a run over several tiles has several."""
    found = np.zeros((0, 3), np.int64)
    longest, octave = int(np.diff(first).max(initial=0)), SMALL // 2
    whole = found
    while 2 * octave <= longest or octave < SMALL:
        begin, end = _tiles(first, octave, least)
        known = _Known(whole, octave // 2)
        some, a = [], 0
        sizes = np.append(0, np.cumsum(end - begin))
        while a < len(begin):
            z = max(a + 1, int(np.searchsorted(sizes, sizes[a] + GROUP, side="right")) - 1)
            edge = sizes[a : z + 1] - sizes[a]
            shift = begin[a:z] - edge[:-1]
            group = np.concatenate([x[s:e] for s, e in zip(begin[a:z].tolist(), end[a:z].tolist(), strict=True)])

            def placed(at, edge=edge, shift=shift):
                return at + shift[np.clip(np.searchsorted(edge, at, side="right") - 1, 0, len(shift) - 1)]

            def inside(lo, hi, placed=placed, known=known):
                at = placed(np.maximum(lo, 0))
                return known(at, at + hi - lo)

            got = _short(group, edge, least) if octave < SMALL else _long(group, edge, octave, least, inside)
            if got:
                got = np.array(got, np.int64)
                at = placed(got[:, 0])
                some.append(np.column_stack([at, at + got[:, 1] - got[:, 0], got[:, 2]]))
            a = z
        if some:
            found = np.concatenate([found, *some])
            whole = _stitched(found)
        octave *= 2
    return found


def _lists(first: np.ndarray, at: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pa.array(values.astype(np.int32)))


def _fragments(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in W.steps(batches):
            w = W.of(batch.column("text"))
            got = solve(_numbers(w), w.first, least)
            got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
            doc = np.searchsorted(w.first, got[:, 0], side="right") - 1
            has = np.zeros(batch.num_rows, bool)
            has[doc] = True
            texts = W.joined_texts(w)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first)),
                    pa.array([t if h else None for t, h in zip(texts, has.tolist(), strict=True)], pa.binary()), pa.array([None if h else hashlib.sha256(t).hexdigest() for t, h in zip(texts, has.tolist(), strict=True)], pa.string()),
                    _lists(w.first, got[:, 0], got[:, 2]), _lists(w.first, got[:, 0], got[:, 0] - w.first[doc]), _lists(w.first, got[:, 0], got[:, 1] - w.first[doc]),
                ],
                ["row", "doc_id", "n_words", "words", "collapsed_sha256", "period", "begin", "finish"],
            )
            row += batch.num_rows

    return run


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run (begin, length, period) keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _collapsed(texts: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, "words"):
            w = W.of(batch.column("words"))
            runs = batch.column("runs")
            part = runs.flatten()
            table = np.column_stack([part.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            off = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            left = [W.joined(w, w.first[i] + np.flatnonzero(kept(int(w.first[i + 1] - w.first[i]), table[off[i] : off[i + 1]]))) for i in range(batch.num_rows)]
            out = [batch.column("doc_id"), batch.column("n_words"), runs, pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, pa.array([t.decode() for t in left], pa.string())][: 4 + texts], ["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"][: 4 + texts])

    return run


def find(docs: DataFrame, least: int = 12, texts: bool = False) -> DataFrame:
    """The runs of words of each document, and what is left when each keeps its first period.

    Args:
        docs: doc_id and text, other columns are ignored. Null and blank texts have no words.
            Rows may repeat, share an id or have none: each row has its own result.
        least: a run has this many words at least, and two periods.
        texts: also return `collapsed` for documents with runs (for the others it is their words, joined).

    Returns:
        doc_id, n_words, runs (array of start, length, period by start, then period),
        collapsed_sha256 of the words that stay, joined by one space.

    A run is as long as its period holds, with the smallest period it has. Texts may be of any
    length: a task holds about 80 bytes for each byte of its longest text.
    """
    marked = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fragments(least), FOUND), "fragments")
    having = marked.where("words is not null")
    each = having.select("row", F.explode(F.arrays_zip("period", "begin", "finish")).alias("f")).select("row", "f.*")
    sorted_ = Window.partitionBy("row", "period").orderBy("begin", "finish")
    before = F.max("finish").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    cut = each.withColumn("new", (before.isNull() | (F.col("begin") > before - F.col("period"))).cast("int"))
    whole = cut.withColumn("piece", F.sum("new").over(sorted_)).groupBy("row", "period", "piece").agg(F.min("begin").alias("start"), (F.max("finish") - F.min("begin")).alias("length"))
    lists = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("start", "period", "length"))))).alias("r"))
    lists = lists.select("row", F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    kind = "array<struct<start:long,length:long,period:long>>"
    schema = f"doc_id long, n_words long, runs {kind}, collapsed_sha256 string" + ", collapsed string" * texts
    some = having.join(lists, "row").select("doc_id", "n_words", "words", "runs").mapInArrow(_collapsed(texts), schema)
    none = marked.where("words is null").select("doc_id", "n_words", F.array().cast(kind).alias("runs"), "collapsed_sha256", *([F.lit(None).cast("string").alias("collapsed")] * texts))
    return some.unionByName(none)

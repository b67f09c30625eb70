"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards by Spark's own partitions. Each shard sorts its word
suffixes, and every suffix of the benchmark is looked up in it by binary search; neighbours
in the suffix array give all verbatim matches, their places and their longest extension.

A suffix of a training text matters only where a stretch of words that all occur in the
benchmark is long enough for a whole window, so a shard leaves the other suffixes out; no
match is lost by that.

The benchmark travels to the executors in blocks of at most `block_bytes` of text, each of
which is broadcast and looked up in a pass of its own, so a large benchmark costs passes
and not memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import stored, without

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: Suffixes of a shard before it is sorted and searched.
SHARD = 1 << 20


@dataclass
class Tests:
    """A block of the benchmark in flat arrays.

    vocabulary: hashes of its words; known: which top 20 bits of a hash occur. ranks: the words
    of all items, as places in the vocabulary from 1 on. Of each distinct window: pos and size,
    where it stands first and its words. first:first + 1 of owners: the items it stands in, and
    likewise of after and end: all places behind it, and where its item ends. names: item ids in
    the order of strings.
    """

    vocabulary: np.ndarray
    known: np.ndarray
    ranks: np.ndarray
    pos: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    owner_first: np.ndarray
    after: np.ndarray
    end: np.ndarray
    after_first: np.ndarray
    names: pa.Array
    shortest: int


def prepare(items: pa.Table, window: int) -> Tests:
    """The windows of items (item_id string, text). Items that share an id are one item with more windows."""
    items = items.combine_chunks()
    texts = items.column("text").chunk(0) if items.num_rows else pa.array([], pa.string())
    w = W.of(texts, W.ALNUM, lower=True)
    vocabulary = np.unique(w.hash)
    ranks = (np.searchsorted(vocabulary, w.hash) + 1).astype(np.int32)
    ids = items.column("item_id").to_pylist()
    names = sorted(set(ids))
    place = {x: i for i, x in enumerate(names)}
    item = np.array([place[x] for x in ids], np.int64)
    n = np.diff(w.first)
    many = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    pos = w.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    size, end = np.minimum(window, n)[row], w.first[1:][row]
    # windows in order of size and words; equal ones stand side by side
    padded = np.append(ranks, np.zeros(window, np.int32))
    word = lambda at, j: np.where(j < size[at], padded[pos[at] + j], 0)
    every = np.arange(len(pos))
    order = np.lexsort([word(every, j) for j in range(window - 1, -1, -1)]) if len(pos) else every
    differs = np.ones(len(pos), bool)
    differs[1:] = False
    for j in range(window):
        x = word(order, j)
        differs[1:] |= x[1:] != x[:-1]
    group = np.cumsum(differs) - 1
    lead = order[differs]
    owned = np.unique(group * len(names) + item[row[order]]) if len(pos) else np.zeros(0, np.int64)
    groups = np.arange(len(lead) + 1)
    return Tests(
        vocabulary,
        np.bincount((vocabulary >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0,
        ranks,
        pos[lead],
        size[lead],
        (owned % max(1, len(names))).astype(np.int32),
        np.searchsorted(owned // max(1, len(names)), groups),
        (pos + size)[order].astype(np.int32),
        end[order].astype(np.int32),
        np.searchsorted(group, groups),
        pa.array(names, pa.string()),
        int(size.min(initial=window)),
    )


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the depth words from each on, by doubling of ranks; 0 ends a text."""
    rank = text.astype(np.int64)
    step = 1
    while step < depth:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-step] = rank[step:]
        # a text that ended stays ended, whatever follows it in the shard
        nxt[rank == 0] = 0
        top = int(rank.max(initial=0)) + 1
        _, rank = np.unique(rank * top + nxt, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, tests: Tests, depth: int, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array that begins with it, by binary search."""
    n = len(order)
    padded = np.append(text, np.zeros(depth, text.dtype))
    ranks = np.append(tests.ranks, np.zeros(depth, np.int32))
    found = np.zeros((2, len(tests.pos)), np.int64)
    for a in range(0, len(tests.pos), step):
        size = tests.size[a : a + step]
        inside = np.arange(depth) < size[:, None]
        rows = ranks[tests.pos[a : a + step][:, None] + np.arange(depth)]
        for upper in (False, True):
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n)
            for _ in range(max(1, n).bit_length() + 1):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                suffix = padded[order[mid][:, None] + np.arange(depth)]
                differs = (suffix != rows[open_]) & inside[open_]
                at = differs.argmax(1)[:, None]
                before = np.take_along_axis(suffix, at, 1)[:, 0] < np.take_along_axis(rows[open_], at, 1)[:, 0]
                right = np.where(differs.any(1), before, upper)
                lo[open_[right]] = mid[right] + 1
                hi[open_[~right]] = mid[~right]
            found[int(upper), a : a + step] = lo
    return found[0], found[1]


def _spread(first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places first[g]:first[g + 1] of each group, one after the other, and which group's each is."""
    n = first[group + 1] - first[group]
    which = np.repeat(np.arange(len(group)), n)
    return np.arange(len(which)) + np.repeat(first[group] - (np.cumsum(n) - n), n), which


def _extend(text: np.ndarray, tests: Tests, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim match that begins with each found window."""
    best = tests.size[group].copy()
    place, row = _spread(tests.after_first, group)
    pos, p, end = (at + tests.size[group])[row], tests.after[place], tests.end[place]
    more = np.zeros(len(pos), np.int64)
    padded, ranks = np.append(text, 0), np.append(tests.ranks, 0)
    live = np.arange(len(pos))
    while len(live):
        q, t = np.minimum(pos[live] + more[live], len(text)), p[live] + more[live]
        live = live[(t < end[live]) & (padded[q] == ranks[np.minimum(t, len(tests.ranks))])]
        more[live] += 1
    np.maximum.at(best, row, tests.size[group][row] + more)
    return best


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each text that overlap or touch, as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    span = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + doc * span)
    new = np.ones(len(doc), bool)
    new[1:] = begin[1:] + doc[1:] * span > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], begin[at], (reach - doc * span)[np.append(at[1:], len(doc)) - 1] if len(at) else end[:0]


def _lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n texts, of values in the order of their texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _find(tests_value, window: int):
    """A row for each text: its words, hit ranges, the items that occur and its longest match."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = tests_value.value
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        text: list[np.ndarray] = []
        place: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = docs = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs
            n = np.concatenate(counts)
            longest = np.zeros(len(n), np.int64)
            hit = group = np.zeros(0, np.int64)
            s = at = doc = np.zeros(0, np.int64)
            if held and len(tests.pos):
                s, at, doc = np.concatenate(text), np.concatenate(place), np.concatenate(owner)
                order = suffix_array(s, window)
                lo, hi = search(s, order, tests, window)
                group = np.repeat(np.arange(len(lo)), hi - lo)
                hit = order[np.repeat(lo, hi - lo) + np.arange(len(group)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                for a in range(0, len(hit), 1 << 16):
                    part, g = hit[a : a + (1 << 16)], group[a : a + (1 << 16)]
                    np.maximum.at(longest, doc[part], _extend(s, tests, part, g))
            of, begin, end = _merged(doc[hit], at[hit], at[hit] + tests.size[group])
            pairs = np.unique(doc[hit] * max(1, len(tests.pos)) + group)
            item, which = _spread(tests.owner_first, pairs % max(1, len(tests.pos)))
            found = np.unique((pairs // max(1, len(tests.pos)))[which] * max(1, len(tests.names)) + tests.owners[item])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array(n),
                    _lists(of, len(n), pa.array(begin)),
                    _lists(of, len(n), pa.array(end)),
                    _lists(found // max(1, len(tests.names)), len(n), tests.names.take(pa.array(found % max(1, len(tests.names))))),
                    pa.array(longest),
                ],
                ["row", "n_words", "begins", "ends", "items", "longest"],
            )
            for x in (ids, counts, text, place, owner):
                x.clear()
            held = docs = 0
            return out

        for batch in W.steps(batches):
            w = W.of(batch.column("text"), W.ALNUM, lower=True)
            h = w.hash
            ids.append(batch.column("row"))
            counts.append(np.diff(w.first))
            maybe = np.flatnonzero(tests.known[(h >> np.uint64(44)).astype(np.int64)])
            rank = np.zeros(len(h), np.int64)
            if len(tests.vocabulary) and len(maybe):
                at = np.searchsorted(tests.vocabulary, h[maybe])
                same = tests.vocabulary[np.minimum(at, len(tests.vocabulary) - 1)] == h[maybe]
                rank[maybe[same]] = at[same] + 1
            doc = w.doc
            edge = np.ones(len(h) + 1, bool)
            if len(h):
                edge[1:-1] = (rank[1:] == 0) | (rank[:-1] == 0) | (doc[1:] != doc[:-1])
            cut = np.flatnonzero(edge)
            size = np.diff(cut)
            good = (size >= tests.shortest) & (rank[cut[:-1]] > 0) if len(h) else np.zeros(0, bool)
            for a, b in zip(cut[:-1][good].tolist(), cut[1:][good].tolist(), strict=True):
                text.append(np.append(rank[a:b], 0))
                place.append(np.arange(a, b + 1) - w.first[doc[a]])
                owner.append(np.full(b - a + 1, docs + doc[a]))
                held += b - a + 1
            docs += batch.num_rows
            if held >= SHARD or docs >= 20_000:
                yield flush()
        if docs:
            yield flush()

    return run


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Find the words of each document that lie in a window of benchmark words.

    Words are stretches of ASCII digits, letters (A-Z lowered) and non-ASCII characters. A
    window is `window` consecutive words of an item; an item of fewer words is one window,
    an item of none has none. A document is contaminated if it has a hit word and the hit
    words times `share` reach its words.

    Returns doc_id, n_words, n_hit, n_items, items (sorted as strings), begins and ends of
    the hit ranges (in words), longest (words of the longest verbatim match) and
    contaminated: a row for each row. Null and empty texts have no words; null items and
    empty benchmark tables hit nothing. Rows are told apart by themselves, so any may lack an
    id or share one. A benchmark of more than `block_bytes` is looked up block by block, on a
    copy of the texts in the shared folder; the result is the same. A task holds a text whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    kind = "{} long, n_words long, begins array<long>, ends array<long>, items array<string>, longest long"
    blocks = (spark.sparkContext.broadcast(prepare(tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).toArrow(), window)) for i in range(n_blocks))
    if n_blocks == 1:
        found = docs.withColumnRenamed("doc_id", "row").mapInArrow(_find(next(blocks), window), kind.format("row")).withColumnRenamed("row", "doc_id")
        found = found.withColumn("n_hit", F.expr("aggregate(zip_with(begins, ends, (b, e) -> e - b), 0L, (s, x) -> s + x)"))
    else:
        # each row has a number that stays the same in all passes
        docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        each = [docs.select("row", "text").mapInArrow(_find(block, window), kind.format("row")) for block in blocks]
        found = reduce(DataFrame.unionByName, each).groupBy("row").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("ranges"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.max("longest").alias("longest"),
        )
        found = docs.select("doc_id", "row").join(found, "row").drop("row")
        n_hit = F.aggregate(
            "ranges",
            F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to")),
            lambda s, r: F.struct((s["hit"] + F.greatest(F.lit(0).cast("long"), r["ends"] - F.greatest(r["begins"], s["to"]))).alias("hit"), F.greatest(r["ends"], s["to"]).alias("to")),
            lambda s: s["hit"],
        )
        found = found.withColumn("n_hit", n_hit).withColumn("begins", F.expr("transform(ranges, r -> r.begins)")).withColumn("ends", F.expr("transform(ranges, r -> r.ends)")).drop("ranges")
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents, whole and with all their columns, whatever their names, that are not contaminated; rows without an id stay."""
    bad = find_contaminated(docs, benchmark, id_col=id_col, **how).where("contaminated").select(F.col("doc_id").alias("id")).distinct()
    return without(docs, bad, id_col)

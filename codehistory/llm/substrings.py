"""Substring deduplication by recompression.

A long repeat of words is found without comparing texts. Rounds rename the word sequence of
every document: a run of one word becomes one symbol, then, round by round, neighbouring
symbols of two classes become one symbol. A name is a hash of its parts, so equal parts have
one name wherever a task meets them; a table in Spark counts the documents of each name of a
round. A symbol depends only on a short interval of words around it (its reach), so inside a
repeat every symbol whose reach lies in the repeat is the same at both places.

1. Whole copies leave first, by the SHA-256 of their words.
2. ROUNDS rounds name runs and pairs over all texts. A window of `window` words that holds a
   symbol which only one document has repeats nothing; a round looks only at symbols that
   some window still needs.
3. What is left of a text becomes stretches. There rounds go on until no new symbol fits a
   window, each window is anchored by its highest symbol, and Spark joins the anchors that
   several documents share: only their windows go on.
4. Windows of shared anchors are named by 96 bits, from two independent hashes of words, and
   Spark finds the first document of each.
5. Words covered by a window that begins in a document with a smaller id are removed. Before,
   they are compared, word for word, with the words of that document.

What a round of step 2 has counted goes to the tasks as a filter of fixed size; where it is
too full to tell names apart, more is left for the joins of step 3, which grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Filter, count_join, discard, hot_keys, membership, stored

WINDOW = 13
#: Rounds whose names filter texts. A symbol of level r spans up to 2^r words or runs of a word. The more documents, the more of them share short
#: symbols by chance: after two rounds what went to the joins grew faster than the texts.
ROUNDS = 3
#: Most ids that are broadcast.
BROADCAST = 1 << 20
#: Bytes of text of a step: a step holds the symbols of all levels.
STEP_BYTES = 1 << 20
_PART = np.uint64(0x9E3779B97F4A7C15)
WINDOWS = "one long, two int, doc_id long, h long, at int"
#: Bits of a window's name that count; fewer in tests, so that names collide.
NAME_BITS = 64


class Level:
    """The symbols of all texts of a batch after a round, in order.

    name: of each symbol; text: its text; lo, hi: first and last word of its reach; fresh:
    whether this round made it.
    """

    def __init__(self, name: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, fresh: np.ndarray) -> None:
        self.name, self.text, self.lo, self.hi, self.fresh = name, text, lo, hi, fresh

    def fits(self, window: int, n: int) -> np.ndarray:
        """Fresh symbols whose reach fits a window."""
        return np.flatnonzero(self.fresh & (self.hi - self.lo < window) & (self.lo >= 0) & (self.hi < n))


def _runs(w: W.Words) -> Level:
    """Runs of one word become one symbol. A symbol's reach takes in the words beside it, which tell where the run ends."""
    h, doc = w.hash, w.doc
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    name = h[at].copy()
    many = size > 1
    name[many] = W.mix(name[many] + size[many].astype(np.uint64), 3)
    return Level(name, doc[at], at - 1, at + size, many)


def _pairs(was: Level, turn: int) -> Level:
    """Neighbours of which the left is in class 1 and the right in class 0 become one symbol; the class is a bit of the name."""
    name, text, lo, hi = was.name, was.text, was.lo, was.hi
    n = len(name)
    left = (W.mix(name, 11 + turn) >> np.uint64(63)).astype(bool)
    head = np.zeros(n, bool)
    head[:-1] = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
    tail = np.zeros(n, bool)
    tail[1:] = head[:-1]
    far_hi, far_lo = hi.copy(), lo.copy()
    far_hi[:-1] = np.where(left[:-1], hi[1:], hi[:-1])
    far_lo[1:] = np.where(left[1:], lo[1:], lo[:-1])
    if n:
        far_hi[-1] += left[-1] * (1 << 40)
        far_lo[0] -= (not left[0]) * (1 << 40)
    out = name.copy()
    at = np.flatnonzero(head)
    out[at] = W.mix(name[at] * _PART + name[at + 1], 29 + turn)
    fresh = head | (was.fresh if turn == 0 else False)
    stay = ~tail
    return Level(out[stay], text[stay], far_lo[stay], far_hi[stay], fresh[stay])


def levels(w: W.Words, window: int) -> Iterator[Level]:
    """Round after round, as long as a new symbol fits a window. The runs belong to the first."""
    level = _runs(w)
    turn = 0
    while True:
        level = _pairs(level, turn)
        if turn and not len(level.fits(window, len(w.start))):
            return
        yield level
        turn += 1


def _alive(w: W.Words, found: Iterable[Level], filters: list[Filter], window: int) -> np.ndarray:
    """Which windows (by their first word) hold no symbol that a filter refuses."""
    n = int(w.first[-1])
    dead = np.zeros(n + 1, np.int32)
    for level, member in zip(found, filters, strict=False):
        at = level.fits(window, n)
        at = at[~member(level.name[at])]
        np.add.at(dead, np.maximum(level.hi[at] - window + 1, 0), 1)
        np.add.at(dead, level.lo[at] + 1, -1)
    return W.whole_windows(w.first, window) & (np.cumsum(dead[:-1]) == 0) if n else np.zeros(0, bool)


def _first_levels(w: W.Words, window: int, n: int) -> list[Level]:
    out = []
    for level in levels(w, window):
        out.append(level)
        if len(out) == n:
            break
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.steps(batches, most=STEP_BYTES):
        w = W.of(batch.column("text"))
        digest = [hashlib.sha256(x).digest() for x in W.joined_texts(w)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.diff(w.first)), pa.array(digest, pa.binary())], ["doc_id", "h", "n_words", "digest"])


def _names(window: int, filters_value):
    """New symbols of the round after those of the filters that some window still needs, with the texts of a step that hold each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = filters_value.value
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            n = len(w.start)
            if not n:
                continue
            found = _first_levels(w, window, len(filters) + 1)
            if len(found) <= len(filters):
                continue
            level = found[-1]
            at = level.fits(window, n)
            needed = np.append(0, np.cumsum(_alive(w, found, filters, window)))
            at = at[needed[level.lo[at] + 1] > needed[np.maximum(level.hi[at] - window + 1, 0)]]
            name, text = level.name[at], level.text[at]
            order = np.lexsort((text, name))
            name, text = name[order], text[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            # texts of this step are summed here, so Spark gets one row for each symbol
            name, n = np.unique(name[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(name)), pa.array(n)], ["name", "n"])

    return run


def _shared(docs: DataFrame, window: int, filters: list[Filter]) -> Filter:
    """The names of a round that several documents share, as a filter."""
    found = docs.mapInArrow(_names(window, docs.sparkSession.sparkContext.broadcast(filters)), "name long, n long")
    names = stored(found.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "names")
    found = membership(names, "name")
    discard(names)
    return found


def _filters(docs: DataFrame, window: int) -> list[Filter]:
    """The names of each round that several documents share."""
    filters: list[Filter] = []
    for _ in range(ROUNDS):
        filters.append(_shared(docs, window, filters))
    return filters


def _stretches(window: int, filters_value):
    """What is left of each text: stretches of windows, with their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = filters_value.value
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            alive = _alive(w, _first_levels(w, window, len(filters)), filters, window)
            doc = w.doc
            edge = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
            # no stretch goes on in the next text, as the last windows of a text are never whole
            begin, end = edge[::2], edge[1::2] + window - 1
            if not len(begin):
                continue
            lo, size = w.start[begin], w.end[end - 1] - w.start[begin]
            to = np.cumsum(size)
            text = w.buf[np.repeat(lo - (to - size), size) + np.arange(int(to[-1]))]
            which = doc[begin]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(which)), batch.column("h").take(pa.array(which)), pa.array((begin - w.first[which]).astype(np.int32)), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, to)), pa.py_buffer(text)]).cast(pa.binary())],
                ["doc_id", "h", "at", "text"],
            )

    return run


def anchors(w: W.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each whole window, and its anchor: the least of the highest new symbols whose reach fits.

    A window in which none fits (as in a long run of one word) is its own anchor. Both choices
    depend on the words of the window alone.
    """
    n = int(w.first[-1])
    begin = np.flatnonzero(W.whole_windows(w.first, window)) if n else np.zeros(0, np.int64)
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    best = W.window_hash(w.hash, window, 1)[begin]
    for level in levels(w, window):
        at = level.fits(window, n)
        key, lo, hi = W.mix(level.name[at], 7), level.lo[at], level.hi[at]
        a, b = np.searchsorted(lo, begin), np.searchsorted(hi, begin + window)
        some = b > a
        if not some.any():
            continue
        best[some] = np.uint64(2**64 - 1)
        for j in range(int((b - a).max())):
            at = np.flatnonzero(a + j < b)
            best[at] = np.minimum(best[at], key[a[at] + j])
    return begin, best


def _anchored(window: int):
    """The distinct anchors of each stretch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            begin, key = anchors(w, window)
            row = w.doc[begin]
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            take = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key[new])), batch.column("doc_id").take(take), batch.column("h").take(take), batch.column("at").take(take)], ["anchor", "doc_id", "h", "at"])

    return run


def _hashed(w: W.Words, begin: np.ndarray, window: int, batch: pa.RecordBatch, bits: int, offset: np.ndarray | None = None) -> pa.RecordBatch:
    """Names and places of windows."""
    row = w.doc[begin]
    at = begin - w.first[:-1][row]
    if offset is not None:
        at = at + offset[row]
    one, two = (W.window_hash(h, window, salt)[begin] if len(begin) else np.zeros(0, np.uint64) for h, salt in ((w.hash, 2), (w.other, 3)))
    two = (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
    if bits < 64:
        one, two = one & np.uint64((1 << 64) - (1 << (64 - bits))), two * 0
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(_signed(one)), pa.array(two), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(at.astype(np.int32))], ["one", "two", "doc_id", "h", "at"])


def _anchored_windows(window: int):
    """Windows of stretches whose anchor is shared."""
    bits = NAME_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            begin, key = anchors(w, window)
            lists = batch.column("anchors")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())).astype(np.uint64)
            known = lists.flatten().to_numpy().view(np.uint64)
            keep = np.isin(W.mix(key + w.doc[begin].astype(np.uint64) * _PART), W.mix(known + of * _PART))
            yield _hashed(w, begin[keep], window, batch, bits, batch.column("at").to_numpy())

    return run


def _left(w: W.Words, i: int, begins: pa.Scalar, window: int) -> np.ndarray:
    """Which words of a text no repeat covers."""
    mark = np.zeros(int(w.first[i + 1] - w.first[i]) + 1, np.int64)
    at = np.unique(begins.values.to_numpy())
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark[:-1]) == 0


def _segments(window: int):
    """The words that are about to go, as stretches that one document is held to have had first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            sources: list[np.ndarray] = []
            texts: list[bytes] = []
            for i in range(batch.num_rows):
                at, first = np.unique(batch.column("begins")[i].values.to_numpy(), return_index=True)
                first = batch.column("firsts")[i].values.to_numpy()[first]
                new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(first) != 0)))
                stop = np.append(new[1:], len(at)) - 1
                sources.append(first[new])
                texts += [W.joined(w, np.arange(a, b + window)) for a, b in zip((at[new] + w.first[i]).tolist(), (at[stop] + w.first[i]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sources), pa.int64()), pa.array(texts, pa.binary())], ["first", "said"])

    return run


def _unsaid(window: int):
    """Windows that documents lack of the words that they are held to have had first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            texts = W.joined_texts(W.of(batch.column("text")))
            where: list[int] = []
            lacking: list[bytes] = []
            for i, text in enumerate(texts):
                text = b" " + text + b" "
                for said in batch.column("said")[i].as_py():
                    if b" " + said + b" " not in text:
                        # windows of one stretch may stand at different places of the document
                        words = said.split(b" ")
                        each = {b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)}
                        lost = [x for x in each if b" " + x + b" " not in text]
                        where += [i] * len(lost)
                        lacking += lost
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(where, pa.int64())), pa.array(lacking, pa.binary())], ["first", "said"])

    return run


def _spelled(window: int, named_value=None):
    """Windows (doc_id, h, at, first, words, one) by their words: those that repeats name, or those of all texts with a name that a filter knows."""
    bits = NAME_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            begin = np.flatnonzero(W.whole_windows(w.first, window)) if len(w.start) else np.zeros(0, np.int64)
            found = _hashed(w, begin, window, batch, bits)
            first = np.full(len(begin), -1, np.int64)
            if named_value is None:
                place = {int(b): k for k, b in enumerate(begin)}
                stay = np.zeros(len(begin), bool)
                for i in range(batch.num_rows):
                    for at, source in zip(batch.column("begins")[i].as_py(), batch.column("firsts")[i].as_py(), strict=True):
                        k = place[int(w.first[i]) + at]
                        stay[k], first[k] = True, source
            else:
                stay = named_value.value(found.column("one").to_numpy().view(np.uint64))
            begin, first, found = begin[stay], first[stay], found.filter(pa.array(stay))
            spelled = pa.array([W.joined(w, np.arange(b, b + window)) for b in begin.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("h"), found.column("at"), pa.array(first), spelled, found.column("one")], ["doc_id", "h", "at", "first", "words", "one"])

    return run


def _cut(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            w = W.of(batch.column("text"))
            n, begins = np.diff(w.first), batch.column("begins")
            stay = [_left(w, i, begins[i], window) for i in range(batch.num_rows)]
            digest = [hashlib.sha256(W.joined(w, w.first[i] + np.flatnonzero(x))).hexdigest() for i, x in enumerate(stay)]
            removed = pa.array(n - np.array([x.sum() for x in stay], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), removed, pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _rewritten(window: int):
    """Texts of (doc_id, text, begins) without the words that repeats cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            begins = batch.column("begins")
            w = W.of(batch.column("text"))
            texts = [W.joined(w, w.first[i] + np.flatnonzero(_left(w, i, begins[i], window))).decode() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(texts, pa.string())], ["id", "h", "new"])

    return run


def _some(ids_value):
    """Rows whose tag passes a filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(ids_value.value(batch.column("tag").to_numpy().view(np.uint64))))

    return run


def _within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents (doc_id, text) that a table of few ids may name: what a join would drop anyway is not shuffled."""
    tags = stored(ids.select(F.xxhash64("doc_id").alias("tag")), "tags")
    tagged = docs.select("doc_id", "h", "text", F.xxhash64("doc_id").alias("tag"))
    known = docs.sparkSession.sparkContext.broadcast(membership(tags, "tag"))
    discard(tags)
    return tagged.mapInArrow(_some(known), tagged.schema).drop("tag")


def _anchor_join(docs: DataFrame, window: int, filters: list[Filter]) -> DataFrame:
    """Windows that hold a shared anchor, by a join that grows with what the filters let pass."""
    left = stored(docs.mapInArrow(_stretches(window, docs.sparkSession.sparkContext.broadcast(filters)), "doc_id long, h long, at int, text binary"), "stretches")
    held = stored(left.mapInArrow(_anchored(window), "anchor long, doc_id long, h long, at int"), "anchors")
    shared = stored(held.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor", "n"), "shared")
    asking = count_join(held, shared, ["anchor"]).groupBy("doc_id", "h", "at").agg(F.collect_set("anchor").alias("anchors"))
    windows = stored(left.join(asking, ["doc_id", "h", "at"]).select("doc_id", "h", "at", "text", "anchors").mapInArrow(_anchored_windows(window), WINDOWS), "windows")
    discard(left, held, shared)
    return windows


def _found(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, h, text), h telling rows of one id apart: (doc_id, h, n_words, digest) of all rows, whole copies of them, and the others that repeat something, with where (doc_id, h, text, begins)."""
    own = stored(docs.mapInArrow(_contents, "doc_id long, h long, n_words long, digest binary"), "contents")
    first = own.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = stored(first, "equal")
    copies = stored(count_join(own, equal, ["digest"]).where("doc_id > first").select("doc_id", "h", "n_words"), "copies")
    discard(equal)
    ids = copies.select("doc_id", "h").distinct()
    asked = docs.where("doc_id is not null")
    # few copies are broadcast to each scan; many are joined away once
    asked = asked.join(F.broadcast(ids), ["doc_id", "h"], "left_anti") if copies.count() <= BROADCAST else stored(asked.join(ids, ["doc_id", "h"], "left_anti"), "single")

    seen = _anchor_join(asked, window, _filters(asked, window))
    named = seen.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    named = stored(named, "first")
    # names that hold much of all windows are broadcast; their windows go on under keys that meet nothing, so no key gathers them
    often = hot_keys(named)
    met = seen.join(F.broadcast(often.withColumnRenamed("first", "near").drop("n")), ["one", "two"], "left")
    met = met.withColumn("two", F.when(F.col("near").isNull(), F.col("two")).otherwise(F.hash("doc_id", "at"))).withColumn("one", F.when(F.col("near").isNull(), F.col("one")).otherwise(F.xxhash64("doc_id", "at")))
    again = met.join(named.join(F.broadcast(often.select("one", "two")), ["one", "two"], "left_anti").drop("n"), ["one", "two"], "left").where("doc_id > coalesce(near, first)")
    again = again.select("doc_id", "h", "at", F.coalesce("near", "first").alias("first"))
    places = stored(again.groupBy("doc_id", "h").agg(F.collect_list("at").alias("begins"), F.collect_list("first").alias("firsts")), "places")
    discard(seen, named)
    repeats = stored(_within(asked, places).join(places, ["doc_id", "h"]).select("doc_id", "h", "text", "begins", "firsts"), "repeats")
    discard(places)
    compared = _compared(asked, repeats, window)
    discard(asked)
    return own, copies, compared


def _compared(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """Repeats whose words the document that is held to have had them first does have, in any of its rows.

    Where two windows share a name and not their words, documents are found anew by the words.
    """
    said = repeats.mapInArrow(_segments(window), "first long, said binary").distinct()
    # the stretches of one document are dealt out, as a much copied one has many
    lists = stored(said.groupBy(F.col("first").alias("doc_id"), F.pmod(F.xxhash64("said"), F.lit(16)).alias("part")).agg(F.collect_list("said").alias("said")), "said")
    sources = _within(docs, lists.select("doc_id").distinct())
    lost = stored(lists.join(sources, "doc_id").select("doc_id", "text", "said").mapInArrow(_unsaid(window), "first long, said binary"), "lost")
    discard(lists)
    if not lost.head(1):
        discard(lost)
        return repeats
    rows = _within(docs, lost.select(F.col("first").alias("doc_id")).distinct()).groupBy(F.col("doc_id").alias("first")).agg(F.count("*").alias("rows"))
    wrong = lost.groupBy("first", F.col("said").alias("words")).agg(F.count("*").alias("n")).join(rows, "first").where("n >= rows").select("first", "words")
    spelled = "doc_id long, h long, at int, first long, words binary, one long"
    doubted = stored(repeats.mapInArrow(_spelled(window), spelled).join(wrong, ["first", "words"]).drop("first"), "doubted")
    known = docs.sparkSession.sparkContext.broadcast(membership(doubted.select("one"), "one"))
    having = docs.mapInArrow(_spelled(window, known), spelled).join(doubted.select("words").distinct(), "words", "left_semi").groupBy("words").agg(F.min("doc_id").alias("first"))
    off = doubted.join(having, "words").where("first >= doc_id").select("doc_id", "h", "at").distinct()
    lists = off.groupBy("doc_id", "h").agg(F.collect_set("at").alias("off"))
    left = F.when(F.col("off").isNull(), F.col("begins")).otherwise(F.array_except("begins", "off"))
    out = stored(repeats.join(lists, ["doc_id", "h"], "left").withColumn("begins", left).where("size(begins) > 0").select("doc_id", "h", "text", "begins"), "repeats")
    discard(repeats, doubted, lost)
    return out


def _again(docs: DataFrame, id_col: str) -> tuple[int, DataFrame]:
    """How many ids several rows have, and those ids if they are few enough to be broadcast."""
    ids = stored(docs.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    n = ids.count()
    if not 0 < n <= BROADCAST:
        discard(ids)
    return n, ids


def _told(rows: DataFrame, again: tuple[int, DataFrame] | None) -> DataFrame:
    """Rows (doc_id, text and others) with h, which tells rows of one id apart: a hash of the text, or 0 where no other row has the id, as a hash in each row of every shuffle does not pack."""
    n, ids = again or (BROADCAST + 1, None)
    if n > BROADCAST:
        return rows.withColumn("h", F.xxhash64("text"))
    if not n:
        return rows.withColumn("h", F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(ids.withColumn("several", F.lit(True))), "doc_id", "left")
    return marked.withColumn("h", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")


def _plain(docs: DataFrame, id_col: str, text_col: str, again: tuple[int, DataFrame] | None = None) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _told(rows, again).select("doc_id", "h", "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Say what is left when every word that a window repeats from a document with a smaller id goes.

    Args:
        docs: a table with a long id and a text; other columns are not read.
        window: words of the shortest repeat.

    Returns doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one
    blank): a row for each row. A null or empty text has no words. Documents of fewer words
    than the window lose nothing. Of equal documents the one with the smallest id stays;
    rows that share an id, with equal texts or not, do not remove each other's words, and what
    any of them says counts as said by that id. Rows with a null id take part in nothing and
    keep their words. A task holds a text whole, and
    about 60 bytes for each byte of the longest one.
    """
    again = _again(docs, id_col)
    own, copies, repeats = _found(_plain(docs, id_col, text_col, again), window)
    discard(again[1])
    cut = repeats.select("doc_id", "text", "begins").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    gone = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    changed = copies.select("doc_id", "h").union(repeats.select("doc_id", "h")).distinct()
    whole = own.join(changed, ["doc_id", "h"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256"))
    return cut.unionByName(gone).unionByName(whole)


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and texts without the words that remove_repeats removes.

    A text that loses words becomes its kept words joined by one blank; every other text,
    null ones too, stays as it is. Whole copies keep their row with an empty text. Columns may
    have any names.
    """
    again = _again(docs, id_col)
    _, copies, repeats = _found(_plain(docs, id_col, text_col, again), window)
    changed = repeats.select("doc_id", "h", "text", "begins").mapInArrow(_rewritten(window), "id long, h long, new string").dropDuplicates(["id", "h"])
    changed = changed.unionByName(copies.select(F.col("doc_id").alias("id"), "h", F.lit("").alias("new")).distinct())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    whole = _told(rows, again).select(F.col("doc_id").alias("id"), "h", "row")
    text = F.coalesce(F.col("new").cast(docs.schema[text_col].dataType), F.col(f"row.`{text_col}`"))
    return whole.join(changed, ["id", "h"], "left").select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))

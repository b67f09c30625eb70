"""Fingerprints of documents: a bounded number of prefix hashes, from which spans of two texts can be compared.

A fingerprint holds the length of a text in UTF-8, the hash of the whole, and hashes of
prefixes at two kinds of places: multiples of a power of two, and marks that the content
chooses (places whose following bytes hash to a number with enough trailing zeros), so that
marks move along when text is put in before them. From prefix hashes follows the hash of any
span between marks, wherever it stands. The longest common beginning of two texts is found
by binary search over the regular places.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import stored
from .prefix import BASES, PRIMES, Prefix

#: Most marks and most regular places of a fingerprint; bytes that decide whether a place is a mark.
MARKS = 24
REGULAR = 16
WINDOW = 8

_BYTE = W.mix(np.arange(1, 257, dtype=np.uint64))
_INVERSE = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))


@dataclass
class Print:
    """length in bytes; whole: hash of all; step: regular places are multiples of 2^step, with half of their hashes (31 bits); level: zeros that a mark has at least; marks: (place, zeros, hash)."""

    length: int
    whole: int
    step: int
    regular: list[int]
    level: int
    marks: list[tuple[int, int, int]]
    seen: dict[int, Counter] = field(default_factory=dict, compare=False, repr=False)

    def __str__(self) -> str:
        marks = ",".join(f"{place:x}/{zeros:x}/{h:x}" for place, zeros, h in self.marks)
        return f"{self.length:x}:{self.whole:x}:{self.step:x}:{','.join(f'{h:x}' for h in self.regular)}:{self.level:x}:{marks}"

    @classmethod
    def parse(cls, text: str) -> Print:
        length, whole, step, regular, level, marks = text.split(":")
        number = lambda x: int(x, 16)
        return cls(number(length), number(whole), number(step), [number(h) for h in regular.split(",") if h], number(level), [tuple(map(number, m.split("/"))) for m in marks.split(",") if m])

    def spans(self, level: int) -> Counter:
        """(length, hash) of the spans between marks of a level, the ends of the text included."""
        if level in self.seen:
            return self.seen[level]
        out: Counter = Counter()
        last, hashes = 0, (0, 0)
        for place, h in [*((p, h) for p, zeros, h in self.marks if zeros >= level and p), (self.length, self.whole)]:
            now = (h >> 31, h & 0x7FFFFFFF)
            out[place - last, *((now[i] - hashes[i]) * pow(_INVERSE[i], last, PRIMES[i]) % PRIMES[i] for i in range(2))] += 1
            last, hashes = place, now
        self.seen[level] = out
        return out


def common_beginning(a: Print, b: Print) -> int:
    """Bytes that two texts begin with in common, as far as regular places tell: a binary search, as a prefix of equal prefixes is equal."""
    if a.length == b.length and a.whole == b.whole:
        return a.length
    step = max(a.step, b.step)
    low, high = 0, min(len(a.regular) >> (step - a.step), len(b.regular) >> (step - b.step))
    while low < high:
        k = (low + high + 1) // 2
        if a.regular[(k << (step - a.step)) - 1] == b.regular[(k << (step - b.step)) - 1]:
            low = k
        else:
            high = k - 1
    return low << step


def likeness(a: Print, b: Print) -> float:
    """0 to 1: bytes in common over the mean length. 1 for equal texts only; common is the longer of the beginning and all spans between marks that both have, wherever."""
    if a.length == b.length and a.whole == b.whole:
        return 1.0
    if not a.length or not b.length:
        return 0.0
    level = max(a.level, b.level)
    both = a.spans(level) & b.spans(level)
    common = max(common_beginning(a, b), sum(span[0] * n for span, n in both.items()))
    return min(2 * common, a.length + b.length - 1) / (a.length + b.length)


def prints(texts: pa.Array) -> list[Print]:
    """The fingerprint of each text; a null is an empty text."""
    buf, off = W.buffer(texts)
    n, begin = np.diff(off), off[:-1]
    hashes = Prefix(buf.astype(np.uint16) + np.uint16(1))
    whole = hashes.span(begin, off[1:])
    # regular places: the smallest power of two that gives at most REGULAR of them
    step = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (REGULAR + 1)))).astype(np.int64)
    step += (n >> step) > REGULAR
    many = n >> step
    owner = np.repeat(np.arange(len(n)), many)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + 1) << step[owner]
    regular = hashes.span(begin[owner], begin[owner] + place) >> np.uint64(31)
    first = np.append(0, np.cumsum(many))

    # marks: windows by doubling, and the zeros at the end of their mixed hash
    h = _BYTE[buf]
    for width in (1, 2, 4):
        h = h[: max(0, len(h) - width)] * np.uint64(0xA0761D6478BD642F ** width & (2**64 - 1)) + h[width:]
    h = W.mix(h, 7)
    least = np.maximum(0, np.log2(np.maximum(n, 1) / MARKS).astype(np.int64) - 3)
    at = np.flatnonzero(h & np.repeat((np.uint64(1) << least.astype(np.uint64)) - np.uint64(1), n)[: len(h)] == 0)
    last = h[at] & (~h[at] + np.uint64(1))
    zeros = np.where(last == 0, 63, np.log2(np.maximum(last, 1).astype(np.float64))).astype(np.int64)
    doc = np.searchsorted(off, at, side="right") - 1
    fits = at + WINDOW <= off[doc + 1]
    at, doc, zeros = at[fits], doc[fits], zeros[fits]
    level = least.copy()
    while True:
        stay = zeros >= level[doc]
        at, doc, zeros = at[stay], doc[stay], zeros[stay]
        over = np.bincount(doc, minlength=len(n)) > MARKS
        if not over.any():
            break
        level[over] += 1
    marked = hashes.span(begin[doc], at)
    edge = np.searchsorted(doc, np.arange(len(n) + 1)).tolist()
    places, ends, values, regular, first = (at - begin[doc]).tolist(), zeros.tolist(), marked.tolist(), regular.tolist(), first.tolist()
    return [
        Print(size, whole_, step_, regular[first[i] : first[i + 1]], level_, list(zip(places[edge[i] : edge[i + 1]], ends[edge[i] : edge[i + 1]], values[edge[i] : edge[i + 1]], strict=True)))
        for i, (size, whole_, step_, level_) in enumerate(zip(n.tolist(), whole.tolist(), step.tolist(), level.tolist(), strict=True))
    ]


def _printed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.steps(batches):
        texts = batch.column("text")
        sizes = [len(t or "") for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([str(p) for p in prints(texts)], pa.string())], ["doc_id", "n_chars", "fingerprint"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of each row of (doc_id, text); a null is an empty text. Nothing is shuffled."""
    return _plain(docs).mapInArrow(_printed, "doc_id long, n_chars long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], edit: Callable[[str, str], str], own: list[Print], other: list[Print]) -> list[pa.Array]:
    """The columns of EDITED for texts, the texts that follow them, and the prints of both."""
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    new = prints(pa.array(edited, pa.string()))
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    near = [likeness(a, b) for a, b in zip(own, new, strict=True)]
    beside = [likeness(a, b) for a, b in zip(own, other, strict=True)]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digest), pa.array([str(p) for p in own]), pa.array([str(p) for p in new]), pa.array(near, pa.float64()), pa.array(beside, pa.float64())]


_NAMES = [c.split()[0] for c in EDITED.split(", ")]


def _along(edit: Callable[[str, str], str]):
    """Rows of sorted partitions with the row that follows each; the first and the last text of a partition come out too, to be joined with those of other partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def end(row: tuple, kind: int) -> pa.RecordBatch:
            none = [pa.array([None], t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *none, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([row[1]], pa.string())], [*_NAMES, "kind", "part", "text"])

        for batch in W.steps(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            own = prints(batch.column("text"))
            if held is None:
                yield end((ids[0], texts[0]), 1)
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [held[2], *own]
            held = (ids[-1], texts[-1], own[-1])
            if len(ids) > 1:
                m = len(ids) - 1
                out = _compared(ids[:-1], texts[:-1], texts[1:], edit, own[:-1], own[1:])
                yield pa.RecordBatch.from_arrays([*out, pa.array([0] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string())], [*_NAMES, "kind", "part", "text"])
        if held is not None:
            yield end(held, 2)

    return run


def _across(edit: Callable[[str, str], str]):
    """The last rows of partitions with the first texts of those that follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id").to_pylist(), texts, following, edit, prints(batch.column("text")), prints(batch.column("following"))), _NAMES)

    return run


def with_edited(docs: DataFrame, edit: Callable[[str, str], str]) -> DataFrame:
    """Fingerprints of each text and of what an edit makes of it and the text of the next document, with their likeness.

    Args:
        docs: doc_id and text, other columns are ignored; a null is an empty text.
        edit: from a text and the next one to an edited text.

    Returns:
        A row for each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
        near_edited, near_next.

    The next document is the one with the next smaller id; after the smallest comes the
    largest; one row alone is followed by itself. Rows that share an id follow each other in
    the order of a hash of their texts, rows without an id come last. Texts are shuffled once,
    by ranges of ids and then of hashes, so many rows of one id do not meet in one task; what
    lies on both sides of a border between tasks is two rows a task, joined by its number. A
    task holds about 60 bytes for each byte of its longest text.
    """
    keyed = _plain(docs).withColumn("h", F.xxhash64("text"))
    order = (F.desc_nulls_last("doc_id"), F.asc("h"))
    ranged = keyed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text").select("doc_id", "text")
    rows = stored(ranged.mapInArrow(_along(edit), EDITED + ", kind int, part int, text string"), "beside", "zstd")
    first, last = rows.where("kind = 1").select("part", F.col("text").alias("following")), rows.where("kind = 2").select("part", "doc_id", "text")
    # two numbers a task: no more rows than partitions
    parts = first.select("part")
    all_ = Window.partitionBy(F.lit(0)).orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(all_), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    met = last.join(after, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    return rows.where("kind = 0").select(*_NAMES).unionByName(met.mapInArrow(_across(edit), EDITED))

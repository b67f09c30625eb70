"""Similarity join on word n-grams with vertical partitioning.

The n-grams of all documents have one global order, rare ones first. The order is cut into
fragments; a document becomes one short segment in each. Two documents can only be similar
if they share an n-gram of their first fragments (the prefix filter), so candidates come
from there; the overlap of a candidate pair is then counted in each fragment by itself and
summed per pair. After FS-Join (Rong et al. 2017), with three changes for hot groups:

- Documents with equal sets are one class; only its smallest id is compared.
- Of each prefix n-gram, members are first compared with one hub: the member whose own
  n-grams are the least unusual, as an original is among its edited copies. That is as many
  pairs as members. What the links of hubs already connect needs no other pair. Only
  members outside the largest component of their n-gram are then compared with the rest.
- A parity bitmap of each set bounds the symmetric difference from below and drops most
  dissimilar pairs inside the join (Sandes et al. 2020). The bound is exact, so no link is
  lost.

How common an n-gram is comes from a sketch of fixed size over all documents. The order
decides the work alone, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, count_join, membership, stored, without

N = 4
PERCENT = 85
FRAGMENTS = 4
#: Cells of the sketch of n-gram frequencies, in segments that Spark sums by themselves.
CELL_BITS, SEGMENT_BITS = 22, 14
BITMAP_LONGS = 8
#: Sets beyond this size have a second, wider bitmap.
LARGE = 1000


def _grams(batch: pa.RecordBatch, n: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, W.Words]:
    """Text number, n-gram and place in the global order of each distinct n-gram, by text and order."""
    w = W.of(batch.column("text"), lower=True)
    h = w.hash
    g = W.window_hash(h, n)
    at = np.flatnonzero(W.whole_windows(w.first, n)) if len(h) else np.zeros(0, np.int64)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    doc = np.concatenate([w.doc[at], short])
    gram = np.concatenate([g[at] if len(at) else np.zeros(0, np.uint64), W.range_hash(h, w.first[short], w.first[short + 1], 9)])
    order = gram >> np.uint64(6)
    if classes is not None:
        order |= classes[(gram & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
    turn = np.lexsort((gram, order, doc))
    doc, gram, order = doc[turn], gram[turn], order[turn]
    new = np.ones(len(doc), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], gram[new], order[new], w


def _signatures(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            doc, gram, _, w = _grams(batch, n)
            count = np.bincount(doc, minlength=batch.num_rows)
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(gram) + 1, np.uint64)
                np.cumsum(W.mix(gram, salt), out=total[1:])
                end = np.cumsum(count)
                sums.append((total[end] - total[end - count]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), *map(pa.array, sums)], ["doc_id", "n", "one", "two"])

    return run


def _counted(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in W.steps(batches):
            h = W.of(batch.column("text"), lower=True).hash
            np.add.at(cells, (W.window_hash(h, n) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), 1)
        parts = np.minimum(cells, 2**32 - 1).astype(np.uint32).reshape(-1, 1 << SEGMENT_BITS)
        at = np.flatnonzero(parts.any(1))
        for i in at.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["segment", "cells"])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(x, np.uint32).astype(np.int64)
            totals[i] = totals[i] + part if i in totals else part
    for i, x in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["segment", "cells"])


def frequency_classes(docs: DataFrame, n: int = N) -> np.ndarray:
    """A class from 0 (rare) to 31 for each cell of the sketch: how often its n-grams occur, in powers of two over the mean.

    All documents are counted; the driver receives 2^CELL_BITS numbers.
    """
    kind = "segment int, cells binary"
    got = docs.select("text").mapInArrow(_counted(n), kind).repartition("segment").mapInArrow(_summed, kind).toArrow()
    cells = np.zeros((1 << CELL_BITS - SEGMENT_BITS, 1 << SEGMENT_BITS), np.int64)
    for i, x in zip(got.column("segment").to_pylist(), got.column("cells").to_pylist(), strict=True):
        cells[i] = np.frombuffer(x, np.uint32)
    flat = cells.ravel()
    usual = flat.mean() + 3 * np.sqrt(flat.mean()) + 4
    return np.clip(np.ceil(np.log2(np.maximum(flat, 1) / usual)), 0, 31).astype(np.uint8)


def _prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size) // 100 + 1


def _prefix(batch: pa.RecordBatch, n: int, percent: int, classes: np.ndarray):
    doc, gram, order, w = _grams(batch, n, classes)
    size = np.bincount(doc, minlength=batch.num_rows)
    begin = np.cumsum(size) - size
    inside = np.arange(len(doc)) - begin[doc] < _prefix_length(size, percent)[doc]
    return doc, gram, size, inside


def _banded(gram: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of an n-gram together with a band of set sizes, and the row of each key.

    A band spans three times the largest ratio of similar sizes. A set near the upper edge of
    its band is in the next one too, so two sets of similar size always meet in a band.
    """
    width = 3 * np.log(100 / percent)
    band = np.floor(np.log(np.maximum(size, 1)) / width)
    more = np.flatnonzero(np.floor((np.log(np.maximum(size, 1) * (100 / percent)) + 1e-9) / width) > band)
    row = np.concatenate([np.arange(len(gram)), more])
    band = np.concatenate([band, band[more] + 1]).astype(np.uint64)
    return W.mix(gram[row] + band * np.uint64(0x9E3779B97F4A7C15), 55), row


def _prefixes(n: int, percent: int, classes_value):
    """How many documents of a step have each key in their prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            doc, gram, size, inside = _prefix(batch, n, percent, classes_value.value)
            key, _ = _banded(gram[inside], size[doc[inside]], percent)
            key, count = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["gram", "n"])

    return run


def _wide(gram: np.ndarray) -> bytes | None:
    """The parity bitmap of a large set, with at least half as many bits as n-grams."""
    if len(gram) <= LARGE:
        return None
    bits = 1 << (len(gram) // 2 - 1).bit_length()
    return np.packbits(np.bincount((W.mix(gram, 78) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _apart(percent: int):
    """Drops pairs whose wide bitmaps are too far apart; the longer is folded, as parities add up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if x is None or y is None:
                    continue
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                n = min(len(x), len(y))
                far = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum(dtype=np.int64)
                stay[i] = far * (100 + percent) <= both[i] * (100 - percent)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(stay))

    return run


def _parity(doc: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
    """A bitmap per text in which each n-gram flips one bit."""
    bits = 64 * BITMAP_LONGS
    flips = np.bincount(doc * bits + (W.mix(gram, 77) % np.uint64(bits)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(rows, BITMAP_LONGS, 64), axis=2, bitorder="little").view(np.int64).reshape(rows, BITMAP_LONGS)


def _members(n: int, percent: int, classes_value, shared_value):
    """A row for each document and prefix key that other documents may share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            doc, gram, size, inside = _prefix(batch, n, percent, classes_value.value)
            key, row = _banded(gram[inside], size[doc[inside]], percent)
            own = doc[inside][row]
            keep = shared_value.value(key) if len(key) else np.zeros(0, bool)
            alone = 1 - np.bincount(own[keep], minlength=batch.num_rows) / np.maximum(1, np.bincount(own, minlength=batch.num_rows))
            own, key = own[keep], key[keep]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[own], pa.int64()), pa.array(size[own].astype(np.int32)), pa.array(alone[own].astype(np.float32))], ["gram", "doc_id", "n", "alone"])

    return run


def _bitmaps(n: int, wanted_value):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps([whole.filter(pa.array(wanted_value.value(whole.column("tag").to_numpy().view(np.uint64))))] if whole.num_rows else []):
                doc, gram, _, _ = _grams(batch, n)
                bitmap = _parity(doc, gram, batch.num_rows)
                edge = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
                wide = [_wide(gram[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(bitmap[:, i].copy()) for i in range(BITMAP_LONGS)), pa.array(wide, pa.binary())], ["doc_id", *(f"b{i}" for i in range(BITMAP_LONGS)), "wide"])

    return run


def _segments(n: int, classes_value, wanted_value):
    """The n-grams of each wanted document, a row for each fragment of the global order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps([whole.filter(pa.array(wanted_value.value(whole.column("tag").to_numpy().view(np.uint64))))] if whole.num_rows else []):
                doc, gram, order, _ = _grams(batch, n, classes_value.value)
                # equal cuts of the rare n-grams, then the common ones
                fragment = np.where(order >> np.uint64(58) > 0, FRAGMENTS - 1, ((order >> np.uint64(38)) * np.uint64(FRAGMENTS - 1) >> np.uint64(20)).astype(np.int64))
                cut = np.ones(len(doc) + 1, bool)
                if len(doc):
                    cut[1:-1] = (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])
                at = np.flatnonzero(cut)
                if len(at) < 2:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc[at[:-1]])), pa.array(fragment[at[:-1]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)))],
                    ["doc_id", "fragment", "grams"],
                )

    return run


def _sized(a: str, b: str, percent: int) -> F.Column:
    """Whether the sizes of two sets allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _near(a: str, b: str, both: F.Column, percent: int) -> F.Column:
    """Whether two bitmaps allow the similarity of sets with `both` elements in all."""
    far = reduce(add, (F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(BITMAP_LONGS)))
    return far * (100 + percent) <= both * (100 - percent)


def _tags(ids: DataFrame):
    """A filter for these ids, broadcast; it tests the hash of an id."""
    tags = stored(ids.distinct().select(F.xxhash64(ids.columns[0]).alias("tag")), "wanted")
    return ids.sparkSession.sparkContext.broadcast(membership(tags, "tag"))


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents of which 100 * common n-grams reach percent * all n-grams of both.

    Words are split at white space after lowering A-Z. A document of fewer than n words has
    its whole sequence as one n-gram; one without words, or a null text, has none and is
    linked with nothing.

    Returns doc_id, n_shingles (size of the set), class_id (smallest id with the same set)
    and component_id (smallest id reachable by links): a row for each row. A null id keeps
    its row and gets null ids. Rows that share an id must share their text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_signatures(n), "doc_id long, n long, one long, two long"), "signatures")
    known = signed.where("n > 0 and doc_id is not null")
    first = known.groupBy("n", "one", "two").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")).where("rows > 1")
    classes = stored(count_join(known, stored(first, "equal"), ["n", "one", "two"], "rows").select("doc_id", "class_id").distinct(), "classes")
    copies = classes.where("doc_id > class_id").select("doc_id")
    rest = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti")

    order = spark.sparkContext.broadcast(frequency_classes(docs, n))
    counted = rest.mapInArrow(_prefixes(n, percent, order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    shared = spark.sparkContext.broadcast(membership(stored(counted, "grams"), "gram"))
    members = stored(rest.mapInArrow(_members(n, percent, order, shared), "gram long, doc_id long, n int, alone float"), "members")
    hubs = members.groupBy("gram").agg(F.min(F.struct("alone", F.xxhash64("doc_id").alias("turn"), "doc_id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("gram", "hub.doc_id", "hub.n")
    wanted = _tags(members.join(hubs.select("gram"), "gram", "left_semi").select("doc_id"))
    bitmaps = rest.withColumn("tag", F.xxhash64("doc_id")).mapInArrow(_bitmaps(n, wanted), "doc_id long, " + ", ".join(f"b{i} long" for i in range(BITMAP_LONGS)) + ", wide binary")
    bitmaps = stored(bitmaps, "bitmaps").dropDuplicates(["doc_id"])
    wide = bitmaps.select("doc_id", "wide").where("wide is not null")
    bitmaps = bitmaps.drop("wide")

    m, h = members.alias("m"), hubs.alias("h")
    met = m.join(h, (F.col("m.gram") == F.col("h.gram")) & (F.col("m.doc_id") != F.col("h.doc_id")) & _sized("m", "h", percent))
    met = _pairs(met, "m", "h").alias("p")
    a, b = bitmaps.alias("x"), bitmaps.alias("y")
    far = met.join(a, F.col("p.a") == F.col("x.doc_id")).join(b, (F.col("p.b") == F.col("y.doc_id")) & _near("x", "y", F.col("p.na") + F.col("p.nb"), percent))
    links = _verified(rest, far.select("p.*"), wide, n, percent, order)

    labels = stored(components(links, name="hubs"), "labels")
    known = stored(bitmaps.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id")).drop("component_id"), "placed")
    placed = members.select("gram", "doc_id", "n").join(known.select("doc_id", "component"), "doc_id")
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("many")).where("many > 1").select("gram", F.col("main.component").alias("main"))
    apart = stored(placed.join(main, "gram").join(known.drop("component"), "doc_id"), "apart")
    o, p = apart.where("component <> main").alias("o"), apart.alias("p")
    left = o.join(p, (F.col("o.gram") == F.col("p.gram")) & (F.col("o.component") != F.col("p.component")) & _sized("o", "p", percent) & _near("o", "p", F.col("o.n") + F.col("p.n"), percent))
    more = _verified(rest, _pairs(left, "o", "p"), wide, n, percent, order)

    joined = components(links.union(more))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(classes.where("doc_id > class_id").withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .drop("_of")
        .join(joined.select(F.col("doc_id").alias("_of"), "component_id"), F.col("class_id") == F.col("_of"), "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    )


def _pairs(joined: DataFrame, a: str, b: str) -> DataFrame:
    ordered = F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")
    pick = lambda x: (F.when(ordered, F.col(f"{a}.{x}")).otherwise(F.col(f"{b}.{x}")), F.when(ordered, F.col(f"{b}.{x}")).otherwise(F.col(f"{a}.{x}")))
    (da, db), (na, nb) = pick("doc_id"), pick("n")
    return joined.select(da.alias("a"), db.alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, wide: DataFrame, n: int, percent: int, order) -> DataFrame:
    """Pairs whose overlaps, counted fragment by fragment and summed, reach the similarity."""
    x, y = (wide.select(F.col("doc_id").alias(k), F.col("wide").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    large = (F.col("na") > LARGE) & (F.col("nb") > LARGE)
    pairs = stored(pairs, "pairs")
    near = pairs.where(large).join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_apart(percent), pairs.schema)
    pairs = stored(pairs.where(~large).unionByName(near), "pairs")
    wanted = _tags(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    segments = docs.withColumn("tag", F.xxhash64("doc_id")).mapInArrow(_segments(n, order, wanted), "doc_id long, fragment int, grams array<long>")
    segments = stored(segments, "segments")
    one = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    two = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("common"))
    # the largest, as repeated rows of a document give a fragment more than once
    total = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common")).groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return stored(total.where((F.col("common") * 100) >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; rows without an id stay."""
    gone = linked(docs, id_col=id_col, text_col=text_col, **how).where("component_id < doc_id").select(F.col("doc_id").alias("id")).distinct()
    return without(docs, gone, id_col)

"""Token files with Simple-8b word-aligned coding.

A file holds blocks, a block holds the ids of some whole documents in order. Ids are packed
into 64-bit words: the top 4 bits of a word are a selector that says how many ids of how
many bits follow. An id that is too wide for the block's limit is written as the largest
number of that width, an escape, and stands in full in a list beside the words. The ids of a
block are cut into lanes of LANE ids; no word crosses a lane, and `jumps` and `skips` hold
the words and the escapes before each lane. So all lanes are coded at once, and a reader can
start at any lane.

A block is a row of a Parquet file, so files live in any store that Spark writes to:
part and block (their order), doc_ids, counts (ids of each document), before (ids of the
part before this block), limit, words, escapes, jumps, skips.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import shared_dir
from .memory import Memory, gather

#: Ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
LIMITS = (10, 12, 15, 20, 30, 60)
LANE = 1024
BLOCK_IDS = 1 << 18
#: Free places after the ids of a lane, as its last word may have room for more.
_SPARE = int(COUNTS.max())
STEP_BYTES = 6 << 20
#: Distinct units whose ids a worker remembers, and bytes of the longest one.
REMEMBERED, LONG = 600_000, 64


#: The selector index of the narrowest width for each small number.
_WIDTH = np.searchsorted(1 << BITS, np.arange(1 << 16), side="right").astype(np.int8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """Words, escaped ids, the bit limit, jumps and skips of a block of ids below 2^32."""
    ids = ids.astype(np.uint64)
    n, lanes = len(ids), -(-len(ids) // LANE)
    cost = [(n * b + 32 * int((ids >= np.uint64((1 << b) - 1)).sum()), b) for b in LIMITS]
    limit = min(cost)[1]
    top = np.uint64((1 << limit) - 1)
    out = ids >= top
    escapes = ids[out].astype(np.uint32)
    skips = np.append(0, np.cumsum(out))[np.arange(lanes) * LANE]
    if not n:
        return np.zeros(0, np.uint64), escapes, limit, np.zeros(0, np.int64), skips
    stride = LANE + _SPARE
    code = np.zeros((lanes, stride), np.uint64)
    code.ravel()[np.arange(n) // LANE * stride + np.arange(n) % LANE] = np.where(out, top, ids)
    code = code.ravel()
    # the selector of a word that begins here: the one of most ids of which all are narrow enough
    width = _WIDTH[np.minimum(code, len(_WIDTH) - 1).astype(np.int64)]
    big = np.flatnonzero(code >= len(_WIDTH))
    width[big] = np.searchsorted(np.uint64(1) << BITS.astype(np.uint64), code[big], side="right")
    choice = np.empty(len(code), np.int8)
    widest, last = width, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        # the widest id of the next COUNTS[s], from that of the next `last`
        more = widest.copy()
        np.maximum(widest[: -(COUNTS[s] - last) or None], widest[COUNTS[s] - last :], out=more[: -(COUNTS[s] - last) or None])
        widest, last = more, COUNTS[s]
        np.putmask(choice, widest <= s, s)
    end = np.arange(lanes) * stride + np.minimum(LANE, n - np.arange(lanes) * LANE)
    at, open_, begins, owners = np.arange(lanes) * stride, np.arange(lanes), [], []
    while len(open_):
        begins.append(at)
        owners.append(open_)
        at = at + COUNTS[choice[at]]
        more = at < end[open_]
        if not more.all():
            at, open_ = at[more], open_[more]
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    begin.sort()
    jumps = np.cumsum(np.bincount(owner, minlength=lanes)) - np.bincount(owner, minlength=lanes)
    selector = choice[begin].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        parts = code[begin[mine][:, None] + np.arange(COUNTS[s])] << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))
        words[mine] |= np.bitwise_or.reduce(parts, axis=1)
    return words, escapes, limit, jumps, skips


def unpack(words: np.ndarray, escapes: np.ndarray, limit: int, jumps: np.ndarray, n: int) -> np.ndarray:
    """The n ids of some lanes, given the words before each of them."""
    lanes, stride = len(jumps), LANE + _SPARE
    selector = (words >> np.uint64(60)).astype(np.int64)
    total = np.append(0, np.cumsum(COUNTS[selector]))
    lane = np.repeat(np.arange(lanes), np.diff(np.append(jumps, len(words))))
    begin = total[:-1] - total[jumps][lane] + lane * stride if lanes else np.zeros(0, np.int64)
    out = np.zeros(lanes * stride, np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        parts = words[mine][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])) & np.uint64((1 << int(BITS[s])) - 1)
        out[begin[mine][:, None] + np.arange(COUNTS[s])] = parts
    out = out.reshape(lanes, stride)[:, :LANE].ravel()[:n]
    out[out == np.uint64((1 << limit) - 1)] = escapes
    return out.astype(np.uint32)


def span(words: np.ndarray, escapes: np.ndarray, limit: int, jumps: np.ndarray, skips: np.ndarray, n: int, a: int, b: int) -> np.ndarray:
    """Ids a to b of a block of n, from the lanes that hold them alone."""
    if a >= b:
        return np.zeros(0, np.uint32)
    first, last = a // LANE, -(-b // LANE)
    to = lambda x, end: int(x[last]) if last < len(x) else end
    part = words[int(jumps[first]) : to(jumps, len(words))]
    more = escapes[int(skips[first]) : to(skips, len(escapes))]
    return unpack(part, more, limit, jumps[first:last] - jumps[first], min(n, last * LANE) - first * LANE)[a - first * LANE : b - first * LANE]


#: White space beyond blank and line end that the cutting pattern knows, as UTF-8.
_OTHER_WHITE = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_CODES = np.array(sorted(int.from_bytes(x.ljust(3, b"\0"), "big") for x in _OTHER_WHITE))


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


class Encoder:
    """Ids of whole texts from the tokenizers library, which is asked once for each distinct unit.

    A byte-level tokenizer cuts a text by a pattern before it merges. Where blanks and line
    ends are the only white space, the pattern always cuts before the last of them in front
    of a word, and before a run of them; and between a letter and a mark, but for the
    apostrophe, that may begin an ending. Between those cuts lie the units. They cover the
    text, so its ids are those of its units. A text with other white space, or with the string
    of an added token, is one unit.
    """

    _loaded: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, special: bool = True, most: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not special
        form = json.loads(self.model.to_str())
        cut = form["pre_tokenizer"] or {}
        #: whether texts may be cut into units
        self.cuts = form["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True)
        self.added = [t["content"].encode() for t in form["added_tokens"]]
        self.memory = Memory(most)

    @classmethod
    def load(cls, path: str, special: bool = True) -> Encoder:
        if (path, special) not in cls._loaded:
            cls._loaded[path, special] = cls(path, special)
        return cls._loaded[path, special]

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that are not cut into units."""
        if not self.cuts:
            return np.arange(len(off) - 1)
        odd = [np.flatnonzero((buf < 0x20) & (buf != 0x0A))]
        lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        if len(lead):
            padded = np.append(buf, np.zeros(2, np.uint8)).astype(np.int64)
            code = (padded[lead] << 16) | (padded[lead + 1] << 8) | np.where(padded[lead] == 0xC2, 0, padded[lead + 2])
            odd.append(lead[np.isin(code, _CODES)])
        raw = buf.tobytes() if self.added else b""
        for name in self.added:
            if (at := raw.find(name)) >= 0:
                places = []
                while at >= 0:
                    places.append(at)
                    at = raw.find(name, at + 1)
                odd.append(np.array(places))
        return np.unique(np.searchsorted(off, np.concatenate(odd), side="right") - 1)

    def _units(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where units begin."""
        white = (buf == 0x20) | (buf == 0x0A)
        first = np.zeros(len(buf) + 1, bool)
        first[off] = True
        cut = first[:-1].copy()
        cut[1:] |= white[1:] & ~white[:-1]
        cut[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]
        letter = _LETTER[buf]
        # letters of two bytes after 0xC3
        letter[1:] |= (buf[1:] >= 0x80) & (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        mark = _MARK[buf]
        begins = _LETTER[buf]
        begins[:-1] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
        whole = self._whole(buf, off)
        if len(whole):
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, off[whole], 1)
            np.add.at(inside, off[whole + 1], -1)
            cut &= (np.cumsum(inside[:-1], dtype=np.int8) == 0) | first[:-1]
        return np.flatnonzero(cut)

    def _ask(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size, ids = [], []
        for a in range(0, len(names), 4096):
            got = [x.ids for x in self.model.encode_batch_fast(names[a : a + 4096], add_special_tokens=False)]
            size += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        return np.array(size, np.int64), np.concatenate(ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has; a null is an empty text."""
        buf, off = W.buffer(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begin = self._units(buf, off)
        edge = np.append(begin, len(buf)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        names, index = units.dictionary.to_pylist(), units.indices.to_numpy()
        memory = self.memory
        row = np.fromiter((memory.place.get(x, -1) for x in names), np.int64, len(names))
        known = row >= 0
        memory.seen[row[known]] += 1
        where, size = memory.begin[row], memory.size[row]
        new = np.flatnonzero(~known)
        if len(new):
            # long units are not remembered: they stand at the end of the pool for this call
            new = new[np.argsort([len(names[i]) > LONG for i in new.tolist()], kind="stable")]
            asked = [names[i] for i in new.tolist()]
            size[new], ids = self._ask(asked)
            where[new] = memory.append(ids) + np.cumsum(size[new]) - size[new]
        out = gather(memory.pool, where[index], size[index])
        if len(new):
            kept = sum(len(x) <= LONG for x in asked)
            memory.add(asked[:kept], where[new[:kept]], size[new[:kept]])
            if kept < len(asked):
                memory.used = int(where[new[kept]])
            memory.tidy()
        ends = np.append(0, np.cumsum(size[index]))[np.searchsorted(begin, off)]
        return out, np.diff(ends)


BLOCK = "part int, block long, doc_ids array<long>, counts array<long>, before long, `limit` int, words binary, escapes binary, jumps array<int>, skips array<int>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_KINDS = [pa.int32(), pa.int64(), _LONGS, _LONGS, pa.int64(), pa.int32(), pa.binary(), pa.binary(), _INTS, _INTS]


def _blocks(path: str, special: bool, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder.load(path, special)
        block = before = size = 0
        held_ids: list = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, size
            ids, n = np.concatenate(held), np.concatenate(counts)
            words, escapes, limit, jumps, skips = pack(ids)
            row = [part, block, held_ids.copy(), n, before, limit, words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes(), jumps, skips]
            block, before, size = block + 1, before + len(ids), 0
            for x in (held_ids, held, counts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], [x.split()[0].strip("`") for x in BLOCK.split(", ")])

        for batch in W.steps(batches, most=STEP_BYTES):
            ids, n = encoder(batch.column("text"))
            with_end = np.full(len(ids) + len(n), end_id, np.uint32)
            place = np.ones(len(with_end), bool)
            place[np.cumsum(n + 1) - 1] = False
            with_end[place] = ids
            held.append(with_end)
            counts.append(n + 1)
            held_ids.extend(batch.column("doc_id").to_pylist())
            size += len(with_end)
            if size >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each with an end id, in ascending id order to token files.

    Args:
        path: a new folder in a store that all executors see.
        tokenizer: a file for the tokenizers library, at the same place on every executor.
        special: whether the string of a special token in a text is that token, as the
            library has it by default, or ordinary text.

    A null text is an empty one. A null id comes first. Rows that share an id stand together.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_blocks(tokenizer, special, end_id), BLOCK).write.parquet(path)


class _Block:
    """A row of token files."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        one = batch.slice(i, 1)
        array = lambda name: one.column(name).flatten().to_numpy(zero_copy_only=False)
        self.doc_ids, self.counts = one.column("doc_ids").flatten(), array("counts")
        self.edge = np.append(0, np.cumsum(self.counts))
        self.begin = one.column("before")[0].as_py() + one.column("skipped")[0].as_py() if "skipped" in batch.schema.names else 0
        raw = lambda name, kind: np.frombuffer(one.column(name)[0].as_buffer(), kind)
        self.coded = raw("words", "<u8"), raw("escapes", "<u4"), one.column("limit")[0].as_py(), array("jumps"), array("skips")

    def span(self, a: int, b: int) -> np.ndarray:
        return span(*self.coded, int(self.edge[-1]), a, b)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = _Block(batch, i)
            edge, ids = block.edge, block.span(0, int(block.edge[-1]))
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.doc_ids, pa.array(edge[:-1] + block.begin), pa.array(block.counts), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int64)))],
                ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
            )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks, each with the ids of all parts before its own. The driver receives one number of each part file."""
    blocks = spark.read.parquet(path)
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    skipped, total = {}, 0
    for r in sizes:
        skipped[r["part"]] = total
        total += r["n"]
    return blocks.join(F.broadcast(spark.createDataFrame(list(skipped.items()), "part int, skipped long")), "part")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _placed(spark, path).mapInArrow(_read if ids else _digests, kind + ", ids array<long>" * ids)


def _picked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = _Block(batch, i)
            nr = batch.column("nr")[i].as_py()
            ids = [block.span(int(block.edge[k]), int(block.edge[k + 1])).astype(np.int64) for k in nr]
            yield pa.RecordBatch.from_arrays([block.doc_ids.take(pa.array(nr, pa.int64())), pa.array(ids, _LONGS)], ["doc_id", "ids"])


def select(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids of the documents that a table (doc_id) names: doc_id, ids. Only the lanes that hold them are decoded."""
    blocks = spark.read.parquet(path)
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("nr", "doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return blocks.join(places.groupBy("part", "block").agg(F.sort_array(F.collect_list("nr")).alias("nr")), ["part", "block"]).mapInArrow(_picked, "doc_id long, ids array<long>")


def written(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write token files to the shared folder and read their digests back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, **how)
    return read(docs.sparkSession, path, ids=False)

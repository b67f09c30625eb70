"""Language-model scores of documents: the attention model and a counted unigram base.

1. One scan cuts the documents into blocks of a few MB. A block keeps the distinct words of
   its documents once, with training counts and subword ids, and the documents as numbers of
   those words; likewise the distinct pairs of a subword and the one before it. So each
   distinct word of a block is cut into subwords once.
2. Spark sums the counts of each word and each pair over all blocks. The sums over pairs give
   the attention model its vocabulary, classes and biases; a bounded sample begins its weights.
3. Each partition of the blocks trains the weights further, in EVERY rounds on one of EVERY
   spans of its training texts each, so all spans train; Spark averages the changes of a round.
   Texts of one id in RESTING train no weights: they fit the share of the mixture.
4. The counts are joined back to the words and pairs of the blocks, and each block gets its
   own. So the shuffle carries distinct words and pairs of blocks, not tokens, and none
   gathers more rows than there are blocks.
5. The score of a subword mixes its probability under the attention model with its smoothed
   share among what followed the subword before it, over all training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from . import words as W
from .common import stored
from .memory import Memory, gather

#: Bytes of a step, and words of a block of steps.
STEP_BYTES, BLOCK_WORDS = 4 << 20, 2_000_000
#: Words that are scored together, so that what a task holds beside its block is small.
MOST_WORDS = 100_000
#: Bytes of training text that the weights begin with, and characters of the pieces that longer texts are cut into for it.
SAMPLE_BYTES, SAMPLE_TEXT = 5_000_000, 20_000
#: Rounds of averaged training, each on one of as many spans of words of all training texts; windows of a step, and the rate of the first round.
EVERY, SPAN, STEP, RATE = 4, 48, 128, 0.002
#: Of so many ids one rests while weights are trained.
RESTING = 64
#: Subwords of the sample that the share of the mixture is fitted on.
MIXED = 100_000
#: First sums that the changes of a place are dealt to, before those are added.
FAN = 256
#: Groups of preceding subwords, by hash, that the classes of subwords are told apart by.
BEFORE = 64
#: Weights in a row of the table that averages them.
CHUNK = 1 << 16


_models: dict[str, object] = {}


def _pieces(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


#: Distinct words whose subwords a worker remembers, and bytes of the longest one.
REMEMBERED, LONG = 200_000, 64
_remembered: dict[str, Memory] = {}


def _cut(path: str, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of distinct words, each by itself, one after the other, and how many each has."""
    memory = _remembered.setdefault(path, Memory(REMEMBERED))
    row = np.fromiter((memory.place.get(x, -1) for x in names), np.int64, len(names))
    known = row >= 0
    memory.seen[row[known]] += 1
    begin, size = memory.begin[row], memory.size[row]
    new = np.flatnonzero(~known)
    if len(new):
        # long words are not remembered: they stand at the end of the pool for this call
        new = new[np.argsort([len(names[i]) > LONG for i in new.tolist()], kind="stable")]
        asked = [names[i] for i in new.tolist()]
        ids = _pieces(path).encode([x.decode() for x in asked], num_threads=1)
        size[new] = np.fromiter(map(len, ids), np.int64, len(ids))
        begin[new] = memory.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(size[new].sum()))) + np.cumsum(size[new]) - size[new]
    out = gather(memory.pool, begin, size).astype(np.int32)
    if len(new):
        kept = sum(len(x) <= LONG for x in asked)
        memory.add(asked[:kept], begin[new[:kept]], size[new[:kept]])
        if kept < len(asked):
            memory.used = int(begin[new[kept]])
        memory.tidy()
    return out, size


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each pair, one after the other."""
    to = np.cumsum(size)
    return np.repeat(begin - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)


@dataclass
class Texts:
    """Texts as numbers of distinct words: n words each, and the subwords of each distinct word.

    Subword ids are below `end`; the end of a text is `end`, its begin `end` + 1.
    """

    n: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    end: int

    @property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All subwords and ends, how many each text has, and for each where it stands in `ids` (-1 for an end)."""
        size = self.size[self.tokens]
        to = np.append(0, np.cumsum(size))
        edge = np.append(0, np.cumsum(self.n))
        many = np.diff(to[edge]) + 1
        place = np.full(int(many.sum()), -1, np.int32)
        inside = np.ones(len(place), bool)
        inside[np.cumsum(many) - 1] = False
        place[inside] = _spread(self.begin[self.tokens], size)
        return np.append(self.ids, np.int32(self.end))[place], many, place

    def parts(self, most: int) -> Iterator[Texts]:
        """The texts in groups of about so many words, one text at least."""
        edge, a = np.append(0, np.cumsum(self.n)), 0
        while a < len(self.n):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + most, side="right")) - 1)
            yield replace(self, n=self.n[a:b], tokens=self.tokens[edge[a] : edge[b]])
            a = b

    def pair(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The number of a subword after another."""
        return before.astype(np.int64) * (self.end + 2) + own

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside distinct words, by place in `ids` (0 for the first of a word), and the word of each place."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        before = np.append(0, self.ids[:-1])[: len(self.ids)]
        pairs = self.pair(before, self.ids)
        pairs[self.begin[self.size > 0]] = 0
        return pairs, word

    def joints(self, flat: np.ndarray, many: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a word or an end begins among all subwords, and the pairs there."""
        first = np.zeros(len(self.ids) + 1, bool)
        first[self.begin[self.size > 0]] = True
        first[-1] = True
        at = np.flatnonzero(first[place])
        before = np.append(0, flat[:-1])[: len(flat)]
        before[np.cumsum(many) - many] = self.end + 1
        return at, self.pair(before[at], flat[at])


def _distinct(w: W.Words, path: str) -> tuple[Texts, np.ndarray]:
    """The texts of a batch as numbers of its distinct words, and the hashes of those, made odd."""
    at, names = pd.factorize(w.hash)
    first = np.empty(len(names), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    ids, size = _cut(path, W.strings(w, first))
    return Texts(np.diff(w.first), at.astype(np.int32), ids, size, _pieces(path).get_piece_size()), names | np.uint64(1)


def _counted(texts: Texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of distinct words, distinct pairs, and training counts of those."""
    counts = np.bincount(texts.tokens, weights=np.repeat(train, texts.n), minlength=len(texts.size)).astype(np.int64)
    inner, word = texts.inner()
    flat, many, place = texts.flat()
    at, joints = texts.joints(flat, many, place)
    doc = np.searchsorted(np.cumsum(many), at, side="right")
    to, pairs = pd.factorize(np.concatenate([inner[inner > 0], joints]))
    n = np.bincount(to, weights=np.concatenate([counts[word][inner > 0], train[doc]]), minlength=len(pairs)).astype(np.int64)
    order = np.argsort(pairs)
    return counts, pairs[order], n[order]


def _joined(parts: list[tuple]) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The steps of a block (texts, hashes, counts, pairs, pair counts) as one; frequent words come first, as small numbers pack better."""
    texts = [p[0] for p in parts]
    at, names = pd.factorize(np.concatenate([p[1] for p in parts]))
    first = np.empty(len(names), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    shift = np.cumsum([0, *(len(t.size) for t in texts)])
    tokens = np.concatenate([at[k:][t.tokens] for k, t in zip(shift, texts, strict=False)]) if len(texts) > 1 else at[texts[0].tokens]
    order = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    counts = np.bincount(at, weights=np.concatenate([p[2] for p in parts]), minlength=len(names)).astype(np.int64)
    size, ids = np.concatenate([t.size for t in texts]), np.concatenate([t.ids for t in texts])
    own = first[order]
    ids = gather(ids, (np.cumsum(size) - size)[own], size[own])
    to, pairs = pd.factorize(np.concatenate([p[3] for p in parts]))
    n = np.bincount(to, weights=np.concatenate([p[4] for p in parts]), minlength=len(pairs)).astype(np.int64)
    turn = np.argsort(pairs)
    return Texts(np.concatenate([t.n for t in texts]), place[tokens], ids, size[own], texts[0].end), names[order], counts[order], pairs[turn], n[turn]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(x: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x.as_buffer(), 4 * int(n), "zstd"), "<i4")


BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, n_tokens array<long>, tokens binary, words array<long>, counts array<long>, sizes array<int>, subwords binary, pairs array<long>, pair_counts array<long>"


def _blocks(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, pa.list_(pa.bool_()), longs, pa.binary(), longs, longs, pa.list_(pa.int32()), pa.binary(), longs, longs]
        held: list[tuple] = []
        ids: list = []
        marks: list[np.ndarray] = []
        number = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            texts, hashes, counts, pairs, pair_counts = _joined(held)
            row = [part << 32 | number, ids.copy(), np.concatenate(marks), texts.n, _packed(texts.tokens), hashes.view(np.int64), counts, texts.size, _packed(texts.ids), pairs, pair_counts]
            number, size = number + 1, 0
            for x in (held, ids, marks):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in W.steps(batches, most=STEP_BYTES):
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            texts, hashes = _distinct(W.of(batch.column("text"), lower=True), path)
            held.append((texts, hashes, *_counted(texts, ~out)))
            ids.extend(batch.column("doc_id").to_pylist())
            marks.append(out)
            size += len(texts.tokens)
            if size >= BLOCK_WORDS:
                yield flush()
        if held:
            yield flush()

    return run


def _rows(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Each block by itself, with its texts."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            n, size = (one.column(x).flatten().to_numpy() for x in ("n_tokens", "sizes"))
            yield one, Texts(n, _unpacked(one.column("tokens")[0], n.sum()), _unpacked(one.column("subwords")[0], size.sum()), size.astype(np.int64), end)


@dataclass
class Learned:
    """What scoring needs beside the counts of a block: the attention model, its share of the mixture, and sums of pair counts.

    own: smoothed shares of subwords and the end among all; seen, kinds: by subword before,
    how often something followed and how many different ones did.
    """

    model: A.Model
    vocabulary: A.Vocabulary
    mix: float
    own: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray

    def followed(self, pairs: np.ndarray, counts: np.ndarray, without: int = 0) -> np.ndarray:
        """Probability of each pair's subword after the one before it (Witten-Bell), with one case left out if asked."""
        before, own = np.divmod(pairs, len(self.own) + 1)
        kinds = np.maximum(1, self.kinds[before] - (without * (counts == 1)))
        return (np.maximum(0, counts - without) + kinds * self.own[own]) / (np.maximum(0, self.seen[before] - without) + kinds)

    def score(self, texts: Texts, pairs: np.ndarray, counts: np.ndarray, scorer: A.Scorer | None = None) -> np.ndarray:
        """log10 probability of each text with its end, given the training counts of all its pairs (in order)."""
        scorer = scorer or A.Scorer(self.model)
        share = np.append(self.followed(pairs, counts), 0.0).astype(np.float32)
        inner = share[np.searchsorted(pairs, texts.inner()[0])]
        inner = np.append(inner, np.float32(0))
        out = []
        for part in texts.parts(MOST_WORDS):
            flat, many, place = part.flat()
            far = inner[place]
            at, joints = part.joints(flat, many, place)
            far[at] = share[np.searchsorted(pairs, joints)]
            p = np.exp(A.score_flat(scorer, self.vocabulary, flat, many).astype(np.float32))
            p *= np.float32(self.mix)
            far *= np.float32(1 - self.mix)
            p += far
            np.log10(np.maximum(p, np.float32(1e-37)), out=p)
            out.append(np.add.reduceat(p, np.cumsum(many) - many, dtype=float))
        return np.concatenate(out) if out else np.zeros(0)


def _scored(total: int, distinct: int, ends: int, learned_value):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Learned = learned_value.value
        scorer = A.Scorer(learned.model)
        for one, texts in _rows(batches, len(learned.own) - 1):
            pairs, n = one.column("pairs").flatten().to_numpy(), texts.n
            # a word or pair that no other block has counted keeps the count of its block
            counts = np.concatenate([one.column(x).flatten().to_numpy() for x in ("counts", "pair_counts")])
            if one.column("at")[0].is_valid:
                counts[one.column("at").flatten().to_numpy()] = one.column("c").flatten().to_numpy()
            counts, pair_counts = np.split(counts, [len(counts) - len(pairs)])
            cost = np.log10((np.append(counts, ends) + 0.5) / (total + 0.5 * (distinct + 1)))
            doc = np.repeat(np.arange(len(n)), n)
            base = np.bincount(doc, weights=cost[texts.tokens], minlength=len(n)) + cost[-1]
            seen = np.bincount(doc, weights=counts[texts.tokens] > 0, minlength=len(n)).astype(np.int64) + (ends > 0)
            score = learned.score(texts, pairs, pair_counts, scorer)
            yield pa.RecordBatch.from_arrays(
                [one.column("doc_ids").flatten(), one.column("held_out").flatten(), pa.array(n + 1), pa.array(seen), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _resting(ids: list) -> np.ndarray:
    """Which ids rest while weights are trained."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % RESTING == RESTING - 1 for x in ids], bool)


def _spans(texts: Texts, train: np.ndarray, every: int, turn: int = 0) -> tuple[Texts, np.ndarray, np.ndarray]:
    """One of `every` spans of SPAN words of the training texts, counted through all of them from `turn` on: as texts, and whether each begins and ends its own."""
    many = np.where(train, np.maximum(1, -(-texts.n // SPAN)), 0)
    doc = np.repeat(np.arange(len(many)), many)
    nr = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    doc, nr = doc[turn::every], nr[turn::every]
    n = np.minimum(SPAN, texts.n[doc] - nr * SPAN)
    first = (np.cumsum(texts.n) - texts.n)[doc] + nr * SPAN
    return replace(texts, n=n, tokens=texts.tokens[_spread(first, n)]), nr == 0, nr == many[doc] - 1


def _updates(learned_value, every: int, turn: int, rate: float):
    """How one of `every` spans of the training texts of a partition change the weights, times the windows that they gave."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Learned = learned_value.value
        start, v = learned.model, learned.vocabulary
        model = A.Model.__new__(A.Model)
        model.__dict__ = start.__dict__ | {"p": {k: w.copy() for k, w in start.p.items()}}
        adam, n = A.Adam(model), 0
        number = np.append(v.number, v.end)
        for one, texts in _rows(batches, len(learned.own) - 1):
            train = ~one.column("held_out").flatten().to_numpy(zero_copy_only=False).astype(bool)
            some, opens, closes = _spans(texts, train & ~_resting(one.column("doc_ids").flatten().to_pylist()), every, turn)
            a = 0
            for part in some.parts(MOST_WORDS):
                b = a + len(part.n)
                flat, many, _ = part.flat()
                edge = np.append(0, np.cumsum(many))
                mine = [number[flat[edge[i] : edge[i + 1] - 1]] for i in range(len(many))]
                for x, y, on, _ in A.windows(mine, v, opens[a:b], closes[a:b], batch=STEP):
                    adam.step(x, y, on, rate * min(1.0, (adam.i + 1) / 20))
                    n += len(x)
                a = b
        change = np.concatenate([((model.p[k] - start.p[k]) * n).ravel() for k in sorted(start.p)]).astype("<f4")
        if n:
            fan = TaskContext.get().partitionId() % FAN
            for i in range(0, len(change), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([n], pa.int64()), pa.array([change[i : i + CHUNK].tobytes()], pa.binary()), pa.array([fan], pa.int32())], ["chunk", "n", "change", "fan"])

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for c, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            m, x = total.get(c, (0, 0.0))
            total[c] = m + n, x + np.frombuffer(raw, "<f4").astype(np.float64)
    for c, (n, x) in sorted(total.items()):
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n], pa.int64()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["chunk", "n", "change"])


def refine(blocks: DataFrame, learned: Learned, every: int = EVERY, rate: float = RATE) -> Learned:
    """The model after every partition of the blocks has trained it on all its spans: in `every` rounds, each on the mean of the weights of the round before, by windows."""
    for turn in range(every):
        learned = _round(blocks, learned, every, turn, rate * (1 - turn / every))
    return learned


def _round(blocks: DataFrame, learned: Learned, every: int, turn: int, rate: float) -> Learned:
    """A task sends its weights once, in rows that are added up by place, FAN sums of a place first; the driver receives one sum."""
    kind = "chunk int, n long, change binary"
    sent = blocks.select("doc_ids", "held_out", "n_tokens", "tokens", "sizes", "subwords").mapInArrow(_updates(blocks.sparkSession.sparkContext.broadcast(learned), every, turn, rate), f"{kind}, fan int")
    first = sent.repartition("chunk", "fan").drop("fan").mapInArrow(_added, kind)
    got = first.repartition("chunk").mapInArrow(_added, kind).orderBy("chunk").collect()
    if not got:
        return learned
    change, p = np.concatenate([np.frombuffer(r["change"], "<f4") / r["n"] for r in got]), {}
    for k in sorted(learned.model.p):
        w = learned.model.p[k]
        p[k], change = w + change[: w.size].reshape(w.shape).astype(w.dtype), change[w.size :]
    model = A.Model.__new__(A.Model)
    model.__dict__ = learned.model.__dict__ | {"p": p}
    return replace(learned, model=model)


def sampled(training: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_text: int = SAMPLE_TEXT) -> pa.Table:
    """A bounded sample of texts: text, opens and closes (whether it begins and ends its document).

    Long texts are cut into pieces of sample_text characters; a hash of the id and the piece's
    number picks among all pieces, so each part of each text has the same chance.
    """
    usable = training.where("text is not null and doc_id is not null")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = usable.select("doc_id", "text", F.length("text").alias("n")).withColumn("nr", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("n", F.lit(1)) - 1) / sample_text).cast("int"))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("attention"), "nr"), F.lit(1 << 30))
    picked = pieces.withColumn("draw", draw).where(F.col("draw") < int(min(1.0, sample_bytes / max(total, 1)) * (1 << 30)))
    text = F.col("text").substr(F.col("nr") * sample_text + 1, F.lit(sample_text))
    return picked.select(text.alias("text"), (F.col("nr") == 0).alias("opens"), ((F.col("nr") + 1) * sample_text >= F.col("n")).alias("closes"), "draw", "doc_id", "nr").orderBy("draw", "doc_id", "nr").toArrow()


def learn(training: DataFrame, pairs: DataFrame, path: str, blocks: DataFrame | None = None, **sample) -> Learned:
    """The model of a table (doc_id, text) whose pairs (key, c) are counted: all but the first weights comes from all of it.

    The driver receives a few numbers of each subword, the sample and one set of weights.
    """
    spark, n = training.sparkSession, _pieces(path).get_piece_size()
    pairs = pairs.select(F.floor(F.col("key") / (n + 2)).cast("int").alias("before"), (F.col("key") % (n + 2)).cast("int").alias("own"), "key", "c")

    def by(name: str, *what) -> tuple[np.ndarray, ...]:
        got = pairs.groupBy(name).agg(*(x.alias(f"x{i}") for i, x in enumerate(what))).toArrow()
        out = np.zeros((len(what), n + 2), np.int64)
        for i in range(len(what)):
            out[i, got.column(name).to_numpy()] = got.column(f"x{i}").to_numpy()
        return out

    (count,) = by("own", F.sum("c"))
    seen, kinds = by("before", F.sum("c"), F.count("*"))
    own = (count[: n + 1] + 0.5) / (count.sum() + 0.5 * (n + 1))
    v, counts = A.vocabulary(count[:n])
    counts[v.end] = count[n]
    left = pairs.groupBy("own", F.pmod(F.xxhash64("before"), F.lit(BEFORE)).cast("int").alias("group")).agg(F.sum("c").alias("c")).toArrow()
    before = np.zeros((v.size + 2, BEFORE), np.float32)
    np.add.at(before, (np.append(v.number, v.end)[left.column("own").to_numpy()], left.column("group").to_numpy()), left.column("c").to_numpy())
    got = sampled(training, **sample)
    texts = got.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
    ids = subwords(path, texts)
    opens, closes = (got.column(x).to_numpy().astype(bool) for x in ("opens", "closes"))
    rest = _resting(got.column("doc_id").to_pylist())
    model = A.train([v.number[ids[i]] for i in np.flatnonzero(~rest)], v, counts, A.groups(before, counts), opens[~rest], closes[~rest])
    learned = Learned(model, v, 0.5, own, seen, kinds)
    if blocks is not None:
        learned = refine(blocks, learned)
    # a sample in which no text rests fits the share on all of it
    at = np.flatnonzero(rest) if rest.any() else np.arange(len(rest))
    at = at[: int(np.searchsorted(np.cumsum([len(ids[i]) + 1 for i in at]), MIXED)) + 1]
    if len(at):
        first = _distinct(W.of(texts.take(pa.array(at)), lower=True), path)[0]
        flat, many, place = first.flat()
        at, joints = first.joints(flat, many, place)
        every = first.inner()[0][np.maximum(place, 0)] if len(first.ids) else np.zeros(len(flat), np.int64)
        every[at] = joints
        key, at = np.unique(every, return_inverse=True)
        known = spark.createDataFrame(pa.table({"key": key})).join(pairs, "key").select("key", "c").toArrow()
        c = np.zeros(len(key), np.int64)
        c[np.searchsorted(key, known.column("key").to_numpy())] = known.column("c").to_numpy()
        near, far = np.exp(A.score_flat(A.Scorer(learned.model), v, flat, many)), learned.followed(key, c, without=1)[at]
        for _ in range(30):
            learned.mix = float(np.clip((learned.mix * near / (learned.mix * near + (1 - learned.mix) * far)).mean(), 0.01, 0.99))
    return learned


def subwords(path: str, texts: pa.Array) -> list[np.ndarray]:
    """Subword ids of the words of each text, after lowering A-Z."""
    if not len(texts):
        return []
    cut = _distinct(W.of(texts, lower=True), path)[0]
    flat, many, _ = cut.flat()
    return [x[:-1] for x in np.split(flat.astype(np.int64), np.cumsum(many)[:-1])]


def score(docs: DataFrame, path: str, held_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text with a model and a base that learn from the rows not held out.

    Words are split at white space after lowering A-Z; an end follows the last and counts as
    a token. The attention model and the counts of pairs see the subword ids of each word, cut
    by itself with the sentencepiece model at `path`; the score mixes both and includes the end.

    Returns doc_id, held_out, n_tokens, n_known (tokens with a training count), train_tokens,
    base_score and score (log10): a row for each row. A null or empty text is its end alone.
    A null mark counts as not held out, a null id is left out of the sample that weights begin
    with. Texts of one training id in RESTING train no weights but count everywhere else. Equal texts get equal scores. A block holds a text whole, so a task needs about 60
    bytes for each byte of the longest one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(held_col), F.lit(False)).alias("held_out"))
    blocks = stored(docs.mapInArrow(_blocks(path), BLOCK), "blocks")
    # words and pairs are counted and joined back together: words under odd keys, pairs under even ones, and with places after those of the words
    keys = F.concat("words", F.transform("pairs", lambda k: k * 2))
    each = blocks.select("block", F.posexplode(F.arrays_zip(keys.alias("key"), F.concat("counts", "pair_counts").alias("n"))).alias("at", "x")).select("block", "at", "x.key", "x.n")
    counts = stored(each.groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("many")).where("c > 0"), "counts").withColumn("pair", F.col("key").bitwiseAND(F.lit(1).cast("long")) == 0)
    total, distinct = counts.where("not pair").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = blocks.select(F.explode("held_out").alias("h")).where("not h").count()
    learned = spark.sparkContext.broadcast(learn(docs.where(~F.col("held_out")), counts.where("pair").select(F.shiftright("key", 1).alias("key"), "c"), path, blocks))
    # what one block alone has counted needs no way back
    known = each.join(counts.where("many > 1").select("key", "c"), "key").where("c > n").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))
    whole = blocks.select("block", "doc_ids", "held_out", "n_tokens", "tokens", "counts", "sizes", "subwords", "pairs", "pair_counts").join(known, "block", "left")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.mapInArrow(_scored(total + ends, distinct + (ends > 0), ends, learned), kind)

"""Phrases that hold together: best-first growth by words, with bounds from the counts of prefixes.

A phrase of n words is worth 2,000,000 * a / (l + r) at its worst cut into a first part that
occurs l times and a rest that occurs r times. What begins with x occurs at most f(x) times,
and its rest at least as often as itself, so its worth is at most 2,000,000 * f(x) / (f(p) + f(x))
for every beginning p of x: a bound that needs counts of prefixes only. In each language the
prefixes with the best bounds are grown first, down to a threshold; all phrases of that worth
or more are then known, with what decides whether they stay. If too few of them stay, the
threshold goes down. Phrases below it are never counted.

Phrases are counted exactly, by their text. Membership filters of fixed size (hashes of
phrases, 16 MB at most) say which windows of words are worth counting; a window that passes
by mistake is counted like others and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import count_join, membership, stored
from .memory import gather

#: Bytes of text whose windows are counted together before they go to Spark.
STEP_BYTES = 3 << 20
#: Shards in which phrases of one language are ranked before they are ranked together.
SHARDS = 64
#: Width of the bins of worth in which thresholds are sought.
BIN = 1000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_KEEP = ~_CUT
_KEEP[[0x20, 0x09]] = False

COUNTED = "lang string, phrase string, key long, n long"


class _Step:
    """Windows of words of some texts, their keys and pieces."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        w = self.w = W.of(texts, _KEEP, lower=True)
        self.names = [x or "und" for x in langs.to_pylist()]
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in set(self.names)}
        self.doc = w.doc
        self.lang = np.array([known[x] for x in self.names], np.uint64)[self.doc]
        cuts = np.append(0, np.cumsum(_CUT[w.buf], dtype=np.int32))
        new = (cuts[w.start[1:]] > cuts[w.end[:-1]]) | (self.doc[1:] != self.doc[:-1])
        self.piece = np.append(0, np.cumsum(new))[: len(w.start)]

    def whole(self, k: int) -> np.ndarray:
        """Which windows of k words lie in one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def key(self, k: int, other: bool = False) -> np.ndarray:
        h = W.window_hash(self.w.other if other else self.w.hash, k, 11)
        return W.mix(h + self.lang[: len(h)], k)

    def counted(self, k: int, asked: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, key, n) of the windows of k words at some places; a phrase may have several rows."""
        key, other = self.key(k)[asked], self.key(k, True)[asked]
        order = np.argsort(key, kind="stable")
        key, other = key[order], other[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
        at = np.flatnonzero(new)
        places = asked[order[at]]
        word = places[:, None] + np.arange(k)
        size = self.w.end[word] - self.w.start[word]
        size[:, :-1] += 1
        data = gather(self.w.buf, self.w.start[word].ravel(), size.ravel())
        end = np.cumsum(size.ravel())
        data[(end.reshape(-1, k)[:, :-1] - 1).ravel()] = 0x20
        off = np.append(0, end[k - 1 :: k]).astype(np.int32)
        phrases = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
        langs = pa.array(self.names, pa.string()).take(pa.array(self.doc[places]))
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(key[at].view(np.int64)), pa.array(np.diff(np.append(at, len(key))))], ["lang", "phrase", "key", "n"])


def _scan(asked: Callable[[_Step], list[tuple[int, np.ndarray]]], totals: bool = False):
    """Counts of the windows that `asked` names in each step; with totals, also a row without phrase for each language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, most=STEP_BYTES):
            step = _Step(batch.column("text"), batch.column("lang"))
            for k, mask in asked(step):
                at = np.flatnonzero(mask)
                if len(at):
                    yield step.counted(k, at)
            if totals:
                n = np.bincount(step.doc, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(step.names, pa.string()), pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n), np.int64)), pa.array(n)], ["lang", "phrase", "key", "n"])

    return run


def _exact(x: str) -> str:
    return f"cast({x} as decimal(19,0))"


def _worth(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exact: products are decimals."""
    return F.expr(f"({_exact(a)} * 2000000) div ({_exact(l)} + {_exact(r)})")


def _cuts(n: int) -> tuple[Column, Column]:
    """The worst cut (score, k, l, r) of a phrase of n words with counts a, pre of beginnings and suf of ends; and the bound of what begins with it."""
    cuts = F.array(*(F.struct(_worth("a", f"pre[{k - 1}]", f"suf[{n - k - 1}]").alias("score"), F.lit(k).alias("k"), F.col("pre")[k - 1].alias("l"), F.col("suf")[n - k - 1].alias("r")) for k in range(1, n)))
    return F.array_min(cuts), F.array_min(F.array(*(_worth("a", f"pre[{k - 1}]", "a") for k in range(1, n))))


def _nodes(rows: DataFrame, n: int) -> DataFrame:
    """Phrases of n words (lang, phrase, key, a, pre, suf) with cut and bound."""
    cut, bound = _cuts(n)
    return rows.select("lang", "phrase", "key", "a", "pre", "suf", cut.alias("cut"), bound.alias("bound"))


def _grown(counts: DataFrame, shorter: DataFrame, n: int) -> DataFrame:
    """Nodes of the counted phrases of n words whose beginning and end of n - 1 words are nodes."""
    begin = shorter.select("lang", F.col("phrase").alias("begin"), F.concat("pre", F.array("a")).alias("pre"))
    end = shorter.select("lang", F.col("phrase").alias("end"), F.concat("suf", F.array("a")).alias("suf"), F.col("key").alias("end_key"))
    rows = counts.withColumns({"begin": F.substring_index("phrase", " ", n - 1), "end": F.substring_index("phrase", " ", 1 - n)})
    cut, bound = _cuts(n)
    return rows.join(begin, ["lang", "begin"]).join(end, ["lang", "end"]).select("lang", "phrase", "key", "a", "pre", "suf", cut.alias("cut"), bound.alias("bound"), "end_key")


def _staying(nodes: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """Nodes of n words that no phrase of one word more holds with four fifths of their count. What a still longer one would drop, one of n + 1 words drops too."""
    part = lambda column: longer.select("lang", column.alias("phrase"), F.col("a").alias("more"))
    most = part(F.substring_index("phrase", " ", n)).unionByName(part(F.substring_index("phrase", " ", -n))).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = F.col("more").isNull() | F.expr(f"{_exact('more')} * 5 < {_exact('a')} * 4")
    return nodes.join(most, ["lang", "phrase"], "left").where(kept).select("lang", "phrase", "a", "cut")


def _thresholds(pairs: DataFrame, want: int) -> DataFrame:
    """(lang, least): the worth that about `want` pairs of words of a language reach, 0 if there are fewer. At most a thousand bins a language are looked at."""
    bins = pairs.groupBy("lang", F.expr(f"cut.score div {BIN}").alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin")))
    return bins.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= want, F.col("bin") * BIN)), F.lit(0)).alias("least"))


def mine(docs: DataFrame, top: int = 2000, least: int = 30) -> DataFrame:
    """The phrases of 2 to 4 words with the greatest worth in each language.

    Args:
        docs: text and lang, other columns are ignored. A null text is empty, a null lang `und`.
            Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and the ends of lines,
            and those into words at blanks and tabs. Repeated rows count as often as they stand.
        top: phrases of a language that are returned; fewer if it has no more.
        least: occurrences that a phrase needs.

    Returns:
        lang, rank (from 1), phrase, a (its occurrences), l and r (those of the parts of its
        worst cut), n (words of the language), score; by falling score, then falling a, then phrase.

    A phrase that lies in a longer one with four fifths of its occurrences is left out. A task
    holds about 60 bytes for each byte of a step, or of its longest text.
    """
    spark = docs.sparkSession
    asked = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def count(what, name: str, totals: bool = False) -> DataFrame:
        rows = asked.mapInArrow(_scan(what, totals), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.first("key").alias("key"))
        return stored(rows.where(F.col("phrase").isNull() | (F.col("a") >= least)), name)

    def known(rows: DataFrame):
        return spark.sparkContext.broadcast(membership(rows, "key"))

    words = count(lambda s: [(1, s.whole(1))], "words", totals=True)
    single = words.where("phrase is not null")
    often = known(single)

    def pairs_of(s: _Step):
        good = often.value(s.key(1))
        return [(2, s.whole(2) & good[:-1] & good[1:])]

    seen = count(pairs_of, "pairs").withColumns({"one": F.substring_index("phrase", " ", 1), "two": F.substring_index("phrase", " ", -1)})
    # common words have many pairs: their counts are broadcast, those of the others joined
    for place, name in (("one", "pre"), ("two", "suf")):
        of = single.select("lang", F.col("phrase").alias(place), F.col("a").alias("f"))
        seen = stored(count_join(seen, of, ["lang", place], "f").withColumn(name, F.array("f")).drop("f"), name)
    pairs = stored(_nodes(seen, 2), "pairs-bound")
    two = known(pairs)

    want = 2 * top
    limits = stored(_thresholds(pairs, want), "limits")
    while True:
        near = stored(pairs.join(limits, "lang").where("bound >= least"), "frontier")
        grow, judge = known(near), known(near.where("cut.score >= least"))

        def triples_of(s: _Step, grow=grow, judge=judge):
            key = s.key(2)
            good = two.value(key)
            return [(3, s.whole(3) & good[:-1] & good[1:] & (grow.value(key[:-1]) | judge.value(key[1:])))]

        found = count(triples_of, "triples")
        ahead = stored(_grown(found, pairs, 3).join(limits, "lang").where("bound >= least"), "frontier")
        grow3, judge3 = known(ahead), known(ahead.where("cut.score >= least"))
        ends = known(ahead.select(F.col("end_key").alias("key")).distinct())

        def rest_of(s: _Step, grow=grow, judge=judge, grow3=grow3, judge3=judge3, ends=ends):
            """Windows of four words, and those of three that end one and were not counted before."""
            key, key3 = s.key(2), s.key(3)
            good = two.value(key)
            both = good[:-1] & good[1:]
            four = both[:-1] & both[1:] & (grow3.value(key3[:-1]) | judge3.value(key3[1:]))
            three = both & ends.value(key[:-1]) & ~(grow.value(key[:-1]) | judge.value(key[1:]))
            return [(4, s.whole(4) & four), (3, s.whole(3) & three)]

        last = count(rest_of, "rest")
        four, three = last.where("size(split(phrase, ' ')) = 4"), found.unionByName(last.where("size(split(phrase, ' ')) = 3"))
        triples = _grown(three, pairs, 3).drop("end_key")
        quads = _grown(four, triples, 4).drop("end_key")
        settled = _staying(pairs, three, 2).unionByName(_staying(triples, four, 3)).unionByName(quads.select("lang", "phrase", "a", "cut"))
        settled = stored(settled.join(limits, "lang").where("cut.score >= least").drop("least"), "settled")
        have = settled.groupBy("lang").agg(F.count("*").alias("have"))
        open_ = limits.join(have, "lang", "left").where((F.col("least") > 0) & (F.coalesce("have", F.lit(0)) < top)).select("lang")
        if not open_.head(1):
            break
        want *= 8
        lower = _thresholds(pairs, want).join(open_, "lang")
        limits = stored(limits.join(open_, "lang", "left_anti").unionByName(lower), "limits")

    order = (F.desc("score"), F.desc("a"), "phrase")
    rows = settled.select("lang", "phrase", "a", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)).alias("shard"))
    # the first of each shard, so that no task ranks all phrases of a language
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = words.where("phrase is null").select("lang", F.col("a").alias("n"))
    return rows.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

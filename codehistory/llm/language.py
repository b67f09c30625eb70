"""Language identification by prediction by partial matching.

For each language a context tree of variable order is counted on bytes: how often each byte
followed each context of 0 to ORDER bytes. A text is coded under each tree with its
statistics frozen: the longest known context codes the next byte, or an escape (method C)
and then the next shorter context, down to a uniform byte. The language with the shortest
code wins. The cost of a byte depends on it and the ORDER bytes before it, so each distinct
stretch of a batch is coded once and remembered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

ORDER = 4
#: Bytes of training text kept for each language, and characters that are kept of a longer text.
SAMPLE_BYTES, SAMPLE_TEXT = 400_000, 100_000
#: Languages from which on the steps of a scan get smaller, as each has a cost for each stretch of a step.
LANGUAGES = 200
_CACHE_BYTES = 48 << 20


@dataclass
class Tree:
    """Counts of one language: by order, sorted grams with counts, sorted contexts with totals and distinct bytes."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of the lowest byte of each key after its higher bytes."""
        cost, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        for k in range(len(self.grams) - 1, -1, -1):
            gram = key & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = _lookup(self.contexts[k], gram >> np.uint64(8))
            g, known = _lookup(self.grams[k], gram)
            total, distinct = self.totals[k][at], self.distinct[k][at]
            hit = open_ & seen & known
            cost[hit] -= np.log2(self.counts[k][g[hit]] / (total + distinct)[hit])
            miss = open_ & seen & ~known
            cost[miss] -= np.log2((distinct / (total + distinct))[miss])
            open_ &= ~hit
        return cost + 8 * open_


def _lookup(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _keys(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the bytes before it (line ends before the first), and the text it is in."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(buf) + order * len(n), 0x0A, np.uint64)
    place = np.arange(len(buf)) + order * (doc + 1)
    padded[place] = W._LOWER[buf]
    key = padded.copy()
    for k in range(1, order + 1):
        key[k:] |= padded[:-k] << np.uint64(8 * k)
    return key[place], doc


def train(texts: list[bytes], order: int = ORDER) -> Tree:
    """The context tree of some texts."""
    off = np.cumsum([0, *map(len, texts)])
    key, _ = _keys(np.frombuffer(b"".join(texts), np.uint8), off, order)
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for k in range(order + 1):
        grams, counts = np.unique(key & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        contexts, begin = np.unique(grams >> np.uint64(8), return_index=True)
        for part, x in zip(parts, (grams, counts, contexts, np.add.reduceat(counts, begin), np.diff(np.append(begin, len(grams)))), strict=True):
            part.append(x)
    return Tree(*parts)


def _scored(trees_value, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = trees_value.value
        known, costs = np.zeros(0, np.uint64), np.zeros((0, len(names)), np.float32)
        most = _CACHE_BYTES // (8 + 4 * max(1, len(names)))
        letters = np.zeros(256, bool)
        letters[0x41:0x5B] = letters[0x61:0x7B] = True
        for batch in W.steps(batches, most=W.STEP_BYTES * LANGUAGES // max(LANGUAGES, len(names))):
            buf, off = W.buffer(batch.column("text"))
            total = np.zeros((batch.num_rows, len(names)))
            has = np.zeros(batch.num_rows, bool)
            if len(buf):
                key, doc = _keys(buf, off, ORDER)
                key, back = np.unique(key, return_inverse=True)
                at = np.searchsorted(known, key)
                new = np.ones(len(key), bool)
                if len(known):
                    new = known[np.minimum(at, len(known) - 1)] != key
                if new.any() and names:
                    fresh = np.empty((int(new.sum()), len(names)), np.float32)
                    for j, t in enumerate(trees):
                        fresh[:, j] = t.bits(key[new])
                    if len(known) + len(fresh) > most:
                        old = np.flatnonzero(~new)
                        known, costs = known[at[old]], costs[at[old]]
                    known, costs = np.concatenate([known, key[new]]), np.concatenate([costs, fresh])
                    turn = np.argsort(known, kind="stable")
                    known, costs = known[turn], costs[turn]
                here = costs[np.searchsorted(known, key)] if names else np.zeros((len(key), 0))
                for j in range(len(names)):
                    total[:, j] = np.bincount(doc, weights=here[back, j], minlength=batch.num_rows)
                ascii_letters = np.bincount(doc, weights=letters[buf], minlength=batch.num_rows) > 0
                foreign = np.bincount(doc, weights=buf >= 0x80, minlength=batch.num_rows) > 0
                has = ascii_letters
                for i in np.flatnonzero(foreign & ~has).tolist():
                    has[i] = any(c.isalpha() for c in batch.column("text")[i].as_py())
            if names:
                best = total.argmin(1)
                with np.errstate(under="ignore"):
                    score = 1 / np.exp2(np.maximum(total.min(1)[:, None] - total, -1000)).sum(1)
                lang = np.where(has, np.array(names, object)[best], "und")
            else:
                score, lang = np.zeros(batch.num_rows), np.full(batch.num_rows, "und", object)
            size = np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, total.min(1, initial=np.inf) / size if names else 0.0, 0.0))],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return run


def learn(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_text: int = SAMPLE_TEXT) -> dict[str, Tree]:
    """A tree for each language of a table (doc_id, text, lang), on a bounded sample.

    Rows with a null or empty text, a null language or id are not learned from; of a text of
    more than sample_text characters the first ones are. A hash of the id picks about
    sample_bytes of each language, and its first text in any case.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    usable = labelled.where("text <> '' and lang is not null and doc_id is not null").select("doc_id", "lang", F.col("text").substr(1, sample_text).alias("text"), draw.alias("draw"))
    usable = usable.withColumn("bytes", F.octet_length("text"))
    sizes = usable.groupBy("lang").agg(F.sum("bytes").alias("total"), F.max("bytes").alias("longest"), F.min("draw").alias("least"))
    # room for two texts more, as the last one of the draw may be missing from it
    wanted = F.col("draw") < (sample_bytes + 2 * F.col("longest")) / F.col("total")
    picked = usable.join(F.broadcast(sizes), "lang").where(wanted | (F.col("draw") == F.col("least"))).select("lang", "text", "draw", "doc_id").orderBy("draw", "doc_id").toArrow()
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(picked.column("lang").to_pylist(), picked.column("text").to_pylist(), strict=True):
        own = texts.setdefault(lang, [])
        if sum(map(len, own)) < sample_bytes:
            own.append(text.encode())
    return {lang: train(texts[lang]) for lang in sorted(texts)}


def identify(docs: DataFrame, trees: dict[str, Tree], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns doc_id, lang_pred, score (share of the best language among all, by code length)
    and bits_per_byte of the best code: a row for each row. `und` with score 0 stands for a
    null text, a text without letters, and for any text if no language was learned. Of equal
    codes the first language in alphabetical order wins.
    """
    spark = docs.sparkSession
    names = sorted(trees)
    value = spark.sparkContext.broadcast([trees[x] for x in names])
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("lang_pred string, score double, bits_per_byte double").fields])
    return docs.mapInArrow(_scored(value, names), kind)

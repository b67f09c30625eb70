"""Quality rules by divergence from language references.

Two histograms describe a document: its characters by class, and how often it uses each of
the common words of a language. The Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1) to the same histograms of all documents of the language says how unusual
the document is. Short texts deviate by chance, so the limits widen with 1 / sqrt(length),
and the word histogram is not judged below a least length. Base rules (length, repeated
words) come first.
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
from .common import stored

#: A word is common in a language if it is at least one in COMMON of its words, so there are at most COMMON.
COMMON = 500
LEAST_WORDS, JUDGED_WORDS = 50, 60
REPEATED_PERCENT = 50

# Classes of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence marks,
# 6 symbols, 7 other ASCII, 8-10 first bytes of 2, 3 and 4 byte characters, 11 the rest.
CLASSES = 12
_CLASS = np.full(256, 7, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 3, 4
_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 11, 8, 9, 10
_SYMBOL = _CLASS == 6
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


@dataclass
class References:
    """By language: the character histogram, hashes of common words (sorted) and their histogram with a rest."""

    names: list[str]
    characters: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


@dataclass(frozen=True)
class Limits:
    """Largest distances of a kept document: a floor and what short texts add, over sqrt(words)."""

    characters: float = 0.13
    characters_short: float = 0.8
    words: float = 0.22
    words_short: float = 1.6


def _class_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(doc * CLASSES + _CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES)[:, : CLASSES - 1]


def _language_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (hash) and of character classes (small numbers) by language, summed for some steps."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in sorted(held.items()):
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "key", "n"])
        held.clear()

    for batch in W.steps(batches):
        w = W.of(batch.column("text"), lower=True)
        raw, off = W.buffer(batch.column("text"))
        classes = _class_counts(raw, off)
        names = batch.column("lang").to_pylist()
        langs = sorted({x for x in names if x is not None})
        code = np.array([-1 if x is None else langs.index(x) for x in names])
        of_word = code[w.doc]
        for i, lang in enumerate(langs):
            key, n = np.unique(w.hash[of_word == i], return_counts=True)
            held.setdefault(lang, []).append((np.concatenate([key, np.arange(CLASSES - 1, dtype=np.uint64)]), np.concatenate([n, classes[code == i].sum(0)])))
        size += len(w.buf)
        if size >= 8 << 20:
            yield from flush()
            size = 0
    yield from flush()


def references(docs: DataFrame) -> References:
    """Histograms of every language over all documents of (text, lang); null languages and texts are left out.

    The driver receives at most COMMON words and CLASSES numbers a language.
    """
    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_language_words, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = stored(counted, "histograms")
    is_class = F.col("key").between(0, CLASSES - 2)
    totals = counted.where(~is_class).groupBy("lang").agg(F.sum("n").alias("total"))
    rows = counted.join(F.broadcast(totals), "lang").where(is_class | (F.col("n") * COMMON >= F.col("total"))).select("lang", "key", "n", "total").toArrow().to_pylist()
    by_lang: dict[str, list[dict]] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    names = sorted(by_lang)
    characters, words, shares = np.zeros((len(names), CLASSES - 1)), [], []
    for i, lang in enumerate(names):
        own = by_lang[lang]
        for r in own:
            if 0 <= r["key"] < CLASSES - 1:
                characters[i, r["key"]] = r["n"]
        common = sorted((int(np.int64(r["key"]).view(np.uint64)), r["n"] / r["total"]) for r in own if not 0 <= r["key"] < CLASSES - 1)
        words.append(np.array([k for k, _ in common], np.uint64))
        part = np.array([x for _, x in common])
        shares.append(np.append(part, 1 - part.sum()))
    return References(names, characters / np.maximum(characters.sum(1, keepdims=True), 1), words, shares)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms (rows of p, each summing to 1) to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def base(buf: np.ndarray, off: np.ndarray, w: W.Words) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters in words, symbols, repeated lines, words in repeated 3-word windows."""
    n = len(off) - 1
    count = lambda at, on: np.bincount(at[on], minlength=n)
    byte_doc = np.repeat(np.arange(n), np.diff(off))
    inside = W.NOT_WHITE[buf]
    # lines: a text of b bytes has one more line than line ends
    ends = np.flatnonzero(buf == 0x0A)
    has = np.flatnonzero(np.diff(off) > 0)
    begin = np.sort(np.concatenate([off[:-1][has], ends + 1]))
    stop = np.sort(np.concatenate([ends, off[1:][has]]))
    owner = np.sort(np.concatenate([has, byte_doc[ends]]))
    words_before = np.append(0, np.cumsum(inside))
    full = words_before[stop] > words_before[begin] if len(begin) else np.zeros(0, bool)
    begin, stop, owner = begin[full], stop[full], owner[full]
    line = W.span_hash(buf, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    turn = np.lexsort((line, owner))
    same = np.zeros(len(line), bool)
    same[1:] = (line[turn][1:] == line[turn][:-1]) & (owner[turn][1:] == owner[turn][:-1])
    # words in windows of three that the text has twice or more
    at = np.flatnonzero(W.whole_windows(w.first, 3)) if len(w.start) else np.zeros(0, np.int64)
    window, of_window = W.window_hash(w.hash, 3)[at] if len(at) else np.zeros(0, np.uint64), w.doc[at]
    order = np.lexsort((window, of_window))
    window, of_window = window[order], of_window[order]
    twin = np.zeros(len(window), bool)
    twin[1:] = (window[1:] == window[:-1]) & (of_window[1:] == of_window[:-1])
    twin[:-1] |= twin[1:]
    covered = np.zeros(len(w.start) + 2, bool)
    for k in range(3):
        covered[at[order][twin] + k] = True
    covered = covered[: len(w.start)]
    return {
        "n_words": np.diff(w.first),
        "word_chars": count(byte_doc, inside & _LEAD[buf]),
        "n_symbols": count(byte_doc, _SYMBOL[buf]),
        "n_dup_lines": np.bincount(owner[turn][same], minlength=n),
        "n_repeat_words": count(w.doc, covered),
    }


def _judged(value, limits: Limits, repeated: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: References = value.value
        index = {x: i for i, x in enumerate(refs.names)}
        for batch in W.steps(batches):
            buf, off = W.buffer(batch.column("text"))
            exact = W.find(buf, off)
            out = base(buf, off, exact)
            n = out["n_words"]
            failed = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > repeated * n)
            lowered = W.find(buf, off, lower=True)
            classes = _class_counts(buf, off)
            p = classes / np.maximum(classes.sum(1, keepdims=True), 1)
            # a text of an unknown language is held against the one that it is nearest to
            which = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()], int)
            unknown = which < 0
            c, v, near = np.full(len(n), 1.0), np.full(len(n), 1.0), np.full(len(n), np.inf)
            for i, common in enumerate(refs.words):
                mine = np.flatnonzero(unknown | (which == i))
                if not len(mine):
                    continue
                of = np.full(len(n), -1)
                of[mine] = np.arange(len(mine))
                doc = of[lowered.doc]
                hashes, doc = lowered.hash[doc >= 0], doc[doc >= 0]
                slot = np.full(len(doc), len(common))
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    slot = np.where(common[at] == hashes, at, len(common))
                k = len(common) + 1
                own = np.bincount(doc * k + slot, minlength=len(mine) * k).reshape(len(mine), k)
                here = distance(p[mine], refs.characters[i]), distance(own / np.maximum(own.sum(1, keepdims=True), 1), refs.shares[i])
                better = sum(here) < near[mine]
                at = mine[better]
                c[at], v[at], near[at] = here[0][better], here[1][better], sum(here)[better]
            if refs.names:
                root = np.sqrt(np.maximum(n, 1))
                good = (c <= limits.characters + limits.characters_short / root) & ((n < JUDGED_WORDS) | (v <= limits.words + limits.words_short / root))
            else:
                c = v = np.zeros(len(n))
                good = np.ones(len(n), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, out.values()), pa.array(failed), pa.array(~failed & good), pa.array(c), pa.array(v)],
                ["doc_id", *out, "base_failed", "kept", "character_distance", "word_distance"],
            )

    return run


def judge(docs: DataFrame, refs: References, limits: Limits | None = None, repeated: int = REPEATED_PERCENT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Count, measure and judge every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, character_distance and word_distance: a row for each row. A null or empty text has
    no words and fails. A null or unknown language is replaced by the nearest reference;
    without any reference the base rules alone decide.
    """
    value = docs.sparkSession.sparkContext.broadcast(refs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, character_distance double, word_distance double"
    return docs.mapInArrow(_judged(value, limits or Limits(), repeated), T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(kind).fields]))

"""Toxicity as an ordinal regression with cumulative links.

Severity has ordered grades: 0 is clean, the grades above split the toxic labels by how
densely their text carries features that the labels mark. Features are words and stems. One
weight for each serves all thresholds: P(grade <= j) = sigmoid(threshold_j - weights *
features). The weights are sparse and
not negative, so a long clean text around it does not hide what is toxic; proximal steps hold most of them at zero, so that words
which merely occur with a marked word don't count by themselves. The output is the expected
severity.
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

#: Labelled documents that the regression is fitted on, picked by a hash of their id.
SAMPLE = 8_000
FEATURES = 4_096
STEMS = (4, 5, 6, 7, 8)
SPARSITY = 1e-4
GRADES = 3


@dataclass
class Model:
    """Hashes of the features with a weight, the weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - linear[:, None], -60, 60)))


def _features(batch: pa.RecordBatch, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature and value of all features of each text.

    A whole word has value 1 however often it stands there. The beginning of a longer word,
    of 4 to 8 bytes, has its share of the words, as stems come with many endings: at one in
    a hundred the value is full. A single case in a short text has a small value.
    """
    w = W.of(batch.column(text_col), W.ALNUM, lower=True)
    doc, size = w.doc, np.diff(w.first)
    docs, names, values = [], [], []
    for length in (0, *STEMS):
        at = np.flatnonzero(w.end - w.start > length) if length else slice(None)
        name = W.mix(W.span_hash(w.buf, w.start[at], w.start[at] + length), length) if length else w.hash
        name, own = name, doc[at]
        turn = np.lexsort((name, own))
        name, own = name[turn], own[turn]
        edge = np.ones(len(name) + 1, bool)
        if len(name):
            edge[1:-1] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(edge)
        count = np.diff(begin)
        name, own = name[begin[:-1]], own[begin[:-1]]
        docs.append(own)
        names.append(name)
        values.append(np.minimum(1.0, 100 * (count - 0.5) / (size[own] + 30)) if length else np.ones(len(own)))
    return np.concatenate(docs), np.concatenate(names), np.concatenate(values)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each feature has at least half of its full value."""
    for batch in W.steps(batches):
        doc, name, value = _features(batch)
        doc, name = doc[value >= 0.5], name[value >= 0.5]
        toxic = batch.column("toxic").to_numpy() > 0
        name, at = np.unique(name, return_inverse=True)
        t = np.bincount(at, weights=toxic[doc], minlength=len(name)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(name)) - t)], ["feature", "t", "c"])


def _valued(names: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            doc, name, value = _features(batch)
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            hit = names[at] == name
            turn = np.argsort(doc[hit], kind="stable")
            doc, at, value = doc[hit][turn], at[hit][turn], value[hit][turn]
            edge = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (at, value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "features", "values"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> Model:
    """Fit on a bounded sample of labelled rows of (doc_id, text) and (doc_id, toxic).

    Null labels, ids and texts are left out; of several labels of an id the highest counts.
    Without a label of either kind the model finds nothing toxic.
    """
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 60.0))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30))
    # at most about `sample` ids are left, so they may be sent to every executor
    picked = known.where(draw < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    own = stored(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id"), "labelled")
    n_c, n_t = (own.where(F.col("toxic") == x if x == 0 else F.col("toxic") > 0).count() for x in (0, 1))
    if not n_c or not n_t:
        return nothing
    counts = own.mapInArrow(_counted, "feature long, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t + c >= 3").toArrow()
    name, t, c = (counts.column(x).to_numpy() for x in ("feature", "t", "c"))
    gain = _gain(t, c, n_t, n_c)
    best = np.lexsort((name, -gain))[:FEATURES]
    best = best[gain[best] > 12]
    if not len(best):
        return nothing
    best = best[np.argsort(name[best].view(np.uint64))]
    rows = own.mapInArrow(_valued(name[best].view(np.uint64)), "doc_id long, toxic int, features array<long>, values array<double>").toArrow().sort_by("doc_id")
    toxic = rows.column("toxic").to_numpy() > 0
    lists = rows.column("features").to_pylist()
    doc = np.repeat(np.arange(len(toxic)), [len(x) for x in lists])
    col = np.array([i for x in lists for i in x], np.int64)
    value = np.array([v for x in rows.column("values").to_pylist() for v in x], float)
    marked = (t >= 9 * c)[best]
    dense = np.bincount(doc, weights=marked[col] * value, minlength=len(toxic))
    grade = toxic.astype(int)
    for q in range(1, grades - 1):
        grade[toxic & (dense > np.quantile(dense[toxic], q / (grades - 1)))] = q + 1
    weights, thresholds = _solve(doc, col, value, len(best), grade, grades)
    keep = np.abs(weights) > 1e-9
    return Model(name[best[keep]].view(np.uint64), weights[keep], thresholds)


def _gain(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    """Log-likelihood ratio of each word's presence between toxic and clean documents."""
    out = np.zeros(len(t))
    for x, n in ((t, n_t), (c, n_c), (n_t - t, n_t), (n_c - c, n_c)):
        both = (t + c) if x is t or x is c else (n_t + n_c - t - c)
        share = both * (n / (n_t + n_c))
        out += 2 * x * np.log(np.maximum(x, 1e-12) / np.maximum(share, 1e-12))
    return out


def _solve(doc: np.ndarray, col: np.ndarray, value: np.ndarray, n_cols: int, grade: np.ndarray, grades: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal steps on the mean loss of the cumulative-link model with an L1 term and weights from 0 up."""
    n = len(grade)
    w, b = np.zeros(n_cols), np.zeros(grades - 1)
    level = np.array([(grade > j).mean() for j in range(grades - 1)]).clip(1 / (2 * n), 1 - 1 / (2 * n))
    b[:] = np.log1p(-level) - np.log(level)
    per_row = np.bincount(doc, weights=value**2, minlength=n)
    step = 4.0 / (1 + np.quantile(per_row, 0.99)) / (grades - 1)
    v, u, old_w, old_b, momentum = w.copy(), b.copy(), w, b, 1.0
    for _ in range(rounds):
        linear = np.bincount(doc, weights=v[col] * value, minlength=n)
        top = 1 / (1 + np.exp(np.clip(u - linear[:, None], -60, 60)))  # P(grade > j)
        bounds = np.concatenate([np.ones((n, 1)), top, np.zeros((n, 1))], 1)
        p = np.maximum(bounds[np.arange(n), grade] - bounds[np.arange(n), grade + 1], 1e-9)
        slope = np.zeros((n, grades + 1))
        slope[:, 1:-1] = top * (1 - top)
        at = np.arange(n)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p
        d_linear = -(up - down) / n
        d_b = np.zeros(grades + 1)
        np.add.at(d_b, grade, up / n)
        np.add.at(d_b, grade + 1, -down / n)
        new_w = v - step * np.bincount(col, weights=d_linear[doc] * value, minlength=n_cols)
        new_w = np.maximum(new_w - step * SPARSITY, 0)
        new_b = np.maximum.accumulate(u - step * d_b[1:-1])
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, u = new_w + (momentum - 1) / nxt * (new_w - old_w), np.maximum.accumulate(new_b + (momentum - 1) / nxt * (new_b - old_b))
        old_w, old_b, momentum = new_w, new_b, nxt
    return old_w, old_b


def _above(model: Model, batch: pa.RecordBatch, text_col: str = "text") -> np.ndarray:
    """P(grade > j) of each text of a batch."""
    doc, name, value = _features(batch, text_col)
    linear = np.zeros(batch.num_rows)
    if len(model.features) and len(name):
        at = np.minimum(np.searchsorted(model.features, name), len(model.features) - 1)
        linear = np.bincount(doc, weights=np.where(model.features[at] == name, model.weights[at] * value, 0.0), minlength=batch.num_rows)
    return model.above(linear)


def _graded(model_value):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches):
            above = _above(model_value.value, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return run


def _clean(model_value, text_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.steps(batches, text_col):
            yield batch.filter(pa.array(_above(model_value.value, batch, text_col)[:, 0] < 0.5))

    return run


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grade every whole text.

    Returns doc_id, severity (the expected grade), grade (thresholds passed with a
    probability of a half or more), p_toxic (probability of a grade above 0) and toxic
    (p_toxic >= 0.5): a row for each row. A null or empty text has no words and gets what
    the thresholds alone say.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_graded(value), T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("severity double, grade int, p_toxic double, toxic boolean").fields]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns, whatever their names, in one scan; null texts stay unless the thresholds alone reject them."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = plain.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), f"c{docs.columns.index(text_col)}"), plain.schema)
    return kept.toDF(*docs.columns)

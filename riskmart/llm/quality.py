"""Quality classifier: regularised quadratic discriminant over transformed statistics of a text.

Each text gives FEATURES numbers (counts as logarithms, shares as logits). Each class has a mean and a covariance, shrunk towards the diagonal of
the pooled one; from the inverses of their Cholesky factors, kept with the model, come Mahalanobis distances and log determinants,
and the difference of the log densities, with the classes' priors, gives the score. It is fitted on all labelled rows: sums of the
statistics and of their products are added up in Spark, and only those come to the driver.

Empty and null texts are texts with all counts zero, and scored like any other. Labels other than 0 and 1 don't count; a document
with several labels counts once for each. With one class only, or none, the score is the share of label 1 (0.5 without labels). Texts are read whole; an empty table gives no
rows; columns besides the named ones can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common, words

FEATURES = ("bytes", "words", "lines", "word_length", "line_words", "upper", "letters", "digits", "marks", "symbols", "distinct_words", "top_word", "repeated_next", "distinct_lines", "short_words", "upper_words", "marked_words")
SHRINKAGE = 0.1
#: How many bytes, words and lines a usual share counts for.
_BYTES, _WORDS, _LINES = 200.0, 30.0, 5.0
_N = len(FEATURES)
_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _HIGH = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = _MARK if _c in b".,;:!?'\"()-" else _SYMBOL
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 11, 12, 13]] = True


def _logit(k: np.ndarray, n: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """Of the share k / n, drawn to the usual share as if `weight` more had been seen: a few words tell little."""
    return np.log((k + usual * weight) / (n - k + (1 - usual) * weight))


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and how often the most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(owner[begin], minlength=n).astype(float), top.astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = common.text_bytes(texts)
    n = len(texts)
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    share = {}
    for k in (_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _HIGH):
        share[k] = np.diff(np.concatenate([[0], np.cumsum(kind == k)])[offsets]).astype(float)
    w = words.find(data, offsets)
    owner, n_words = _owners(w.first), np.diff(w.first).astype(float)
    h = words.hashes(data, w.start, w.end)
    count = lambda mask: np.bincount(owner[mask], minlength=n).astype(float)
    distinct, top = _distinct(h, owner, n)
    length = (w.end - w.start).astype(float)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    edges = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    uppers = edges[w.end] - edges[w.start]
    edges = np.concatenate([[0], np.cumsum((kind == _SYMBOL) | (data == 33))])
    marked = edges[w.end] > edges[w.start]
    lines = words.find(data, offsets, _NEWLINE)
    n_lines = np.diff(lines.first).astype(float)
    line_distinct, _ = _distinct(words.hashes(data, lines.start, lines.end), _owners(lines.first), n)
    letters = share[_UPPER] + share[_LOWER] + share[_HIGH]
    return np.stack([
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines),
        np.log((np.bincount(owner, length, n) + 6 * _WORDS) / (n_words + _WORDS)), np.log((n_words + 30 * _LINES) / (n_lines + _LINES)),
        _logit(share[_UPPER], letters, 0.03, _BYTES), _logit(letters, size, 0.82, _BYTES), _logit(share[_DIGIT], size, 0.002, _BYTES), _logit(share[_MARK], size, 0.03, _BYTES), _logit(share[_SYMBOL], size, 0.001, _BYTES),
        _logit(distinct, n_words, 0.8, _WORDS), _logit(top, n_words, 0.05, _WORDS), _logit(count(again), n_words, 0.01, _WORDS), _logit(line_distinct, n_lines, 0.98, _LINES),
        _logit(count(length <= 2), n_words, 0.2, _WORDS), _logit(count((uppers >= 2) & (uppers * 2 >= length)), n_words, 0.005, _WORDS), _logit(count(marked), n_words, 0.005, _WORDS),
    ], 1)


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            yield pa.record_batch({"doc_id": batch.column(0), "x": pa.FixedSizeListArray.from_arrays(pa.array(statistics(texts).ravel()), _N).cast(pa.list_(pa.float64()))})

    return common.as_text(df, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    prior: float
    mean: list[np.ndarray]
    inverse: list[np.ndarray]  # of the Cholesky factors of the covariances, made once
    log_det: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.inverse:
            return np.full(len(x), self.prior)
        density = []
        for mean, inverse, log_det in zip(self.mean, self.inverse, self.log_det, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * ((z * z).sum(1) + log_det))
        odds = np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -500, 500)
        return 1 / (1 + np.exp(-odds))


def fit(x: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """x: features(); every row of labels counts whose document is in x."""
    marked = labels.select(labels[id_col].cast("long").alias("of"), labels[label_col].cast("int").alias("label")).where("label in (0, 1)")
    rows = x.join(marked, F.col("doc_id") == F.col("of")).select("label", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + _N + _N * _N))
        for batch in batches:
            label, x_ = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(-1, _N)
            for k in (0, 1):
                own = x_[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.record_batch({"label": pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), "k": pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), "v": pa.array(total.ravel())})

    sums = rows.mapInArrow(moments, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # a few hundred rows
    total = np.zeros((2, 1 + _N + _N * _N))
    for r in sums:
        total[r.label, r.k] = r.v
    n = total[:, 0]
    if not n.all():
        return Model(n[1] / n.sum() if n.sum() else 0.5, [], [], [])
    mean = total[:, 1 : 1 + _N] / n[:, None]
    covariance = total[:, 1 + _N :].reshape(2, _N, _N) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.diag(np.tensordot(n / n.sum(), covariance, 1))
    target = np.diag(np.maximum(pooled, 1e-3))
    factor = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target) for c in covariance]
    return Model(n[1] / n.sum(), list(mean), [np.linalg.inv(f) for f in factor], [2 * float(np.log(np.diag(f)).sum()) for f in factor])


def score(x: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of features()."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(shared.value.score(np.asarray(batch.column(1).flatten()).reshape(-1, _N)))})

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")

"""Toxicity by a classifier chain of logistic regressions.

Categories are predicted in order; each later model also sees the probabilities of the earlier ones. In training those are
out-of-fold predictions (FOLDS folds by hash of the id), so later models learn from probabilities as they will be for new texts. Features are
the words of a text (A-Z lower-cased) and their beginnings of PREFIXES bytes, present or not, hashed into BUCKETS; for each
category the SELECTED buckets that differ most between its two classes (by MIN_Z deviations at least) are kept. A model is fitted on at most SAMPLE labelled rows, chosen by hash of
id and place; every text is scored whole.

Categories are columns of labels. Where there is one column alone, kinds of it are learned to be predicted before it: the texts with label 1 are clustered by their features (k-means of
unit vectors, started from the farthest texts), and each cluster is a category. For out-of-fold predictions the clusters are learned without the fold, and matched with those of all
rows by their centres.

A null label of a category is left out of its training. Null and empty texts have no features, and get the models' base probabilities. Without
both classes of a category its probability is their share (0 without labels). Repeated documents, with one label or with different ones, are learned from and scored each on their own; repeated rows of labels count once; ties between
buckets go to the lower number. An empty table gives no rows. Columns besides the named ones can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common, words
from riskmart.llm.decontamination import SEPARATOR

PREFIXES, BUCKETS = (4, 5, 6), 1 << 18
SAMPLE, SELECTED, FOLDS = 30_000, 300, 3
PENALTY, STEPS, THRESHOLD, MIN_Z = 1.0, 40, 0.4, 4.0
#: Clusters of the texts with label 1, and rounds of k-means.
KINDS, ROUNDS = 2, 10


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and beginning; repeats included."""
    data, offsets = common.text_bytes(texts)
    data = words.ASCII_LOWER[data]
    w = words.find(data, offsets, SEPARATOR)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    found, of = [words.hashes(data, w.start, w.end)], [owner]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        found.append(words.hashes(data, w.start[long], w.start[long] + k) * np.uint64(2 * k + 1))
        of.append(owner[long])
    return np.concatenate(of), (np.concatenate(found) >> np.uint64(64 - 18)).astype(np.int64)


def _distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


@dataclass
class Linear:
    """Weights of the present features, then of the earlier probabilities, then the constant; or a constant probability."""

    weight: np.ndarray
    constant: float | None = None

    def logits(self, row: np.ndarray, column: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        n, k = earlier.shape
        return np.bincount(row, self.weight[column], n) + earlier @ self.weight[len(self.weight) - 1 - k : -1] + self.weight[-1]

    def probability(self, row: np.ndarray, column: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(earlier), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(row, column, earlier), -500, 500)))


def train(row: np.ndarray, column: np.ndarray, earlier: np.ndarray, y: np.ndarray, n_features: int) -> Linear:
    """Logistic regression with an L2 penalty, by limited-memory BFGS."""
    if not len(y) or y.min() == y.max():
        return Linear(np.empty(0), float(y.mean()) if len(y) else 0.0)
    n, k = earlier.shape
    model = Linear(np.zeros(n_features + k + 1))
    model.weight[-1] = np.log(y.mean() / (1 - y.mean()))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        model.weight = w
        z = model.logits(row, column, earlier)
        loss = np.logaddexp(0, z) - y * z
        residual = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        gradient = np.concatenate([np.bincount(column, residual[row], n_features), earlier.T @ residual, [residual.sum()]])
        penalty = w.copy()
        penalty[-1] = 0
        return loss.sum() + 0.5 * PENALTY * (penalty @ penalty), gradient + PENALTY * penalty

    w = model.weight
    value, gradient = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, factors = -gradient, []
        for s, g in reversed(past):
            a = (s @ d) / (s @ g)
            factors.append(a)
            d = d - a * g
        if past:
            s, g = past[-1]
            d = d * ((s @ g) / (g @ g))
        for (s, g), a in zip(past, reversed(factors), strict=True):
            d = d + s * (a - (g @ d) / (s @ g))
        step = 1.0 if past else min(1.0, 1 / max(np.abs(gradient).max(), 1e-12))
        while step > 1e-8:
            new_value, new_gradient = at(w + step * d)
            if new_value <= value + 1e-4 * step * (gradient @ d):
                break
            step /= 2
        else:
            break
        s, g = step * d, new_gradient - gradient
        if s @ g > 1e-12:
            past = [*past[-9:], (s, g)]
        done = abs(value - new_value) < 1e-6 * max(1.0, value)
        w, value, gradient = w + s, new_value, new_gradient
        if done:
            break
    model.weight = w
    return model


@dataclass
class Chain:
    categories: list[str]
    column: np.ndarray  # of each bucket, -1 for those not selected
    models: list[Linear]

    def predict(self, texts: pa.Array) -> np.ndarray:
        """A row of probabilities for each text."""
        row, bucket = features(texts)
        column = self.column[bucket]
        kept = column >= 0
        key = np.unique(row[kept] * BUCKETS + column[kept])
        row, column = key // BUCKETS, key % BUCKETS
        p = np.empty((len(texts), 0))
        for m in self.models:
            p = np.column_stack([p, m.probability(row, column, p)])
        return p


def with_labels(df: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("toxic",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the labels of labelled documents; a document with several different labels counts once for each, so an id with many rows of labels makes no more than that."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), *[labels[c].cast("int").alias(c) for c in columns]).distinct()
    return common.as_text(df, id_col, text_col).join(rows, "doc_id")


def cluster(row: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, -1 for rows that aren't members; unit centres) of the members' unit vectors."""
    out, own = np.full(n_rows, -1), np.flatnonzero(members)
    if not len(own) or not n_columns:
        return np.where(members, 0, -1), np.zeros((k, n_columns))
    number = np.full(n_rows, -1)
    number[own] = np.arange(len(own))
    some = number[row] >= 0
    x = np.zeros((len(own), n_columns), np.float32)
    x[number[row[some]], column[some]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x.mean(0)]
    for _ in range(k):  # the farthest from the mean, then from those before it
        centres.append(x[int(np.max(x @ np.stack(centres).T, 1).argmin())])
    centre = np.stack(centres[1:])
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                centre[j] = x[near == j].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    out[own] = (x @ centre.T).argmax(1)
    return out, centre


def matched(centre: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each centre the number of the one in `to` that it stands for: the most alike first."""
    alike, out = centre @ to.T, np.zeros(len(centre), np.int64)
    for _ in range(len(centre)):
        i, j = np.unravel_index(int(alike.argmax()), alike.shape)
        out[i] = j
        alike[i], alike[:, j] = -np.inf, -np.inf
    return out


def bounded(df: DataFrame, most: int, *by: str) -> DataFrame:
    """df, or if it has more than `most` rows, at most so many of them: those of least hash of the columns and of their place, so rows with one id are told apart."""
    n = df.count()
    if n <= most:
        return df
    name = common.free_name(df.columns, "_hash")
    hashed = df.withColumn(name, F.pmod(F.xxhash64(*by, F.monotonically_increasing_id()), F.lit(1 << 30)))
    # The threshold keeps a fifth more than wanted, so no task and not the driver sorts many more rows.
    return hashed.where(F.col(name) < int(min(1.0, 1.2 * most / n) * (1 << 30))).orderBy(name).limit(most).drop(name)


def sample_labels(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """At most `sample` labelled rows, all if there are no more."""
    return bounded(labels, sample, id_col)


def fit(labelled: DataFrame, categories: tuple[str, ...] = ("toxic",), selected: int = SELECTED, kinds: int = KINDS, sample: int = SAMPLE) -> Chain:
    """labelled: doc_id, text and a 0/1 column for each category; at most `sample` of its rows are used (many documents can have one labelled id). With one category, `kinds` of it come before it."""
    k = len(categories)
    common.ship(labelled.sparkSession)
    labelled = common.materialise(labelled.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in categories]), "labelled")
    whole, labelled = labelled, bounded(labelled, sample, "doc_id")
    if labelled is not whole:  # chosen once, for all that follows
        labelled = common.materialise(labelled, "labelled")
        common.discard(whole)

    def label_matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(2 + j).fill_null(-1)) for j in range(k)], 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, 2, BUCKETS), np.int32), np.zeros((k, 2), np.int64)
        for batch, texts in common.slices(batches):
            row, bucket = _distinct(*features(texts))
            y = label_matrix(batch)
            for j in range(k):
                for c in (0, 1):
                    own = y[:, j] == c
                    n[j, c] += own.sum()
                    total[j, c] += np.bincount(bucket[own[row]], minlength=BUCKETS).astype(np.int32)
        yield pa.record_batch({"n": pa.array([n.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    total, n = np.zeros((k, 2, BUCKETS)), np.zeros((k, 2))
    for r in labelled.coalesce(8).mapInArrow(count, "n binary, counts binary").collect():  # at most eight rows
        total += np.frombuffer(r.counts, np.int32).reshape(total.shape)
        n += np.frombuffer(r.n, np.int64).reshape(n.shape)
    rate = total / np.maximum(n, 1)[:, :, None]
    mean = total.sum(1) / np.maximum(n.sum(1), 1)[:, None]
    z = np.abs(rate[:, 1] - rate[:, 0]) / np.sqrt(mean * (1 - mean) * (1 / np.maximum(n, 1)).sum(1)[:, None] + 1e-9)
    z[total.sum(1) < 3] = 0
    chosen = sorted({int(b) for j in range(k) for b in np.argsort(-z[j], kind="stable")[:selected] if z[j, b] > MIN_Z})
    column = np.full(BUCKETS, -1, np.int64)
    column[chosen] = np.arange(len(chosen))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            row, bucket = _distinct(*features(texts))
            c = column[bucket]
            row, c = row[c >= 0], c[c >= 0]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(c, pa.int32()))
            yield pa.record_batch({"doc_id": batch.column(0), "y": pa.FixedSizeListArray.from_arrays(pa.array(label_matrix(batch).ravel(), pa.int32()), k).cast(pa.list_(pa.int32())), "c": lists})

    rows = sorted(labelled.mapInArrow(pick, "doc_id long, y array<int>, c array<int>").collect(), key=lambda r: (r.doc_id is None, r.doc_id))  # the bounded sample
    common.discard(labelled)
    given = np.array([r.y for r in rows], np.int64).reshape(-1, k)
    row = np.repeat(np.arange(len(rows)), [len(r.c) for r in rows])
    col = np.array([c for r in rows for c in r.c], np.int64)
    fold = np.array([common.crc32(np.array([r.doc_id or 0], np.int64)) % FOLDS for r in rows], np.int64)
    models, earlier = [], np.empty((len(rows), 0))
    names, kinds = list(categories), kinds if k == 1 else 0
    names = [f"{names[0]}_kind_{j + 1}" for j in range(kinds)] + names

    def labels(inside: np.ndarray, centre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all categories for the rows inside, and the centres of the kinds; in the order of the centres given."""
        if not kinds:
            return given, np.empty((0, 0))
        of, own = cluster(row, col, len(rows), len(chosen), inside & (given[:, 0] == 1), kinds)
        if centre is not None:
            of = np.where(of >= 0, matched(own, centre)[of], -1)
        y = np.where(given >= 0, of[:, None] == np.arange(kinds), -1)
        return np.column_stack([y, given]), own

    every = np.ones(len(rows), bool)
    y, centre = labels(every)
    without = [labels(fold != f, centre)[0] for f in range(FOLDS)]

    def on(mask: np.ndarray, target: np.ndarray) -> Linear:
        mask = mask & (target >= 0)
        number = np.cumsum(mask) - 1
        inside = mask[row]
        return train(number[row[inside]], col[inside], earlier[mask], target[mask].astype(float), len(chosen))

    for j in range(len(names)):
        out = np.zeros(len(rows))
        if j + 1 < len(names):  # out-of-fold predictions for the models to come
            for f in range(FOLDS):
                out[fold == f] = on(fold != f, without[f][:, j]).probability(row, col, earlier)[fold == f]
        models.append(on(every, y[:, j]))
        earlier = np.column_stack([earlier, out])
    return Chain(names, column, models)


def predict(df: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> of every text, and is_toxic: the last category's probability is at least the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            p = shared.value.predict(texts)
            yield pa.record_batch([batch.column(0), *[pa.array(x) for x in p.T], pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "is_toxic"])

    return common.as_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in names) + ", is_toxic boolean")

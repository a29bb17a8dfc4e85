"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased one by one; runs of others than letters count as one space. N-grams of ORDERS characters are
hashed into BUCKETS. The model is fitted on a sample of about SAMPLE documents for each language (all of them if there are fewer, one at least), chosen by
hash of id and text; counts of documents and the prior are of all labelled rows, and all their languages are learned. The matrix of log probabilities
is broadcast, and a batch is scored as sparse counts times that matrix. The score is the posterior
of the predicted language, with log likelihoods divided by the number of orders, as they overlap.

The matrix takes 256 KB a language. It is made, broadcast and used in blocks of BLOCK languages (32 MB); with more languages than that, one block is scored after the
other, each on what the last one wrote, with the best language so far, its score and the logarithm of the sum of all. The result is the same.

A null text and one without a letter are `und` with score 0. Without any labelled row, everything is `und`. Equal scores go to the language
that is first in order. Repeated rows are learned from and predicted each on their own. Long texts are read whole, in blocks of n-grams. Columns of df that have the names
of the two new ones are replaced by them; an empty table gives an empty one with these columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm import common

ORDERS, BUCKETS = (1, 2, 3), 1 << 16
SAMPLE, BLOCK, SMOOTHING = 3000, 128, 0.5
UNKNOWN = "und"
_BLOCK = 1 << 19
_tables: list[np.ndarray] = []
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and whether it is a letter (marks within words count too)."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
        _tables.extend([lower, letter])
    return _tables[0], _tables[1]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of all texts, the number of each one's text, and the number of letters of each text."""
    lower, letter = _classes()
    data, offsets = common.text_bytes(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(chars))
    is_letter = letter[codes]
    letters = np.bincount(text[is_letter], minlength=len(texts))
    codes = np.where(is_letter, lower[codes], np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (text[1:] != text[:-1])
    return codes[keep], text[keep], letters


def grams(codes: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of the text) of all n-grams, in blocks that bound the memory however long a text is."""
    for n in ORDERS:
        for a in range(0, len(codes) - n + 1, _BLOCK):
            m = min(_BLOCK, len(codes) - n + 1 - a)
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ codes[a + k : a + k + m]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            same = text[a : a + m] == text[a + n - 1 : a + n - 1 + m]
            yield (h & np.uint32(BUCKETS - 1))[same], text[a : a + m][same]


@dataclass
class Model:
    """languages in order; blocks: for BLOCK of them each, the prior and the log probabilities (BUCKETS x languages)."""

    languages: list[str]
    blocks: list[tuple[np.ndarray, np.ndarray]]


def totals(texts: pa.Array, prior: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log probability of each text with each language of a block (texts x languages), and the number of letters of each text."""
    codes, text, letters = characters(texts)
    total = np.zeros((len(texts), len(prior)))
    for bucket, owner in grams(codes, text):
        # Sparse counts: a row for each text and bucket that it has.
        key, count = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        row, column = key // BUCKETS, key % BUCKETS
        for k in range(len(prior)):
            total[:, k] += np.bincount(row, count * log_p[column, k].astype(np.float64), len(texts))
    return total / len(ORDERS) + prior, letters


def fit(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> Model:
    """From all rows of df with a language and a text. One row for each language, and one for each language and bucket of a block, come to the driver."""
    common.ship(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)))
    counts = sorted(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect())
    n_all, blocks = sum(r.n for r in counts), []
    for at in range(0, len(counts), block):
        own = counts[at : at + block]
        number = {r.lang: k for k, r in enumerate(own)}
        # A row is in if its hash is among the first sample / n of all hash values of its language, or the least of it.
        bounds = df.sparkSession.createDataFrame([(r.lang, max(int(min(1.0, sample / r.n) * (1 << 30)), r.least + 1)) for r in own], "lang string, below long")
        chosen = rows.join(F.broadcast(bounds), "lang").where("h < below").select("text", "lang")
        cells = len(own) * BUCKETS

        def count(batches: Iterator[pa.RecordBatch], number=number, cells=cells) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells, np.int64)
            for batch, texts in common.slices(batches):
                codes, text, _ = characters(texts)
                lang = np.array([number[x] for x in batch.column(1).to_pylist()])
                for bucket, owner in grams(codes, text):
                    total += np.bincount(lang[owner] * BUCKETS + bucket, minlength=cells)
            cell = np.flatnonzero(total)
            yield pa.record_batch({"cell": pa.array(cell, pa.int64()), "n": pa.array(total[cell], pa.int64())})

        found = chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.full(cells, SMOOTHING)
        total[np.asarray(found.column("cell").combine_chunks())] += np.asarray(found.column("n").combine_chunks())
        total = total.reshape(len(own), BUCKETS)
        log_p = np.log(total / total.sum(1, keepdims=True)).astype(np.float32).T
        blocks.append((np.log(np.array([r.n for r in own], float) / n_all), np.ascontiguousarray(log_p)))
    return Model([r.lang for r in counts], blocks)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "lang_score") -> DataFrame:
    """df with two more columns (which replace those of these names)."""
    common.ship(df.sparkSession)
    df = df.drop(lang_name, score_name)
    names = df.columns
    if not model.languages:
        return df.select("*", F.lit(UNKNOWN).alias(lang_name), F.lit(0.0).alias(score_name))
    # Of the blocks so far: the best language's number (-1: no letter), its log probability, the logarithm of the sum of all probabilities.
    best, top, both = (common.free_name(names, x) for x in ("best", "top", "sum"))
    schema = T.StructType([*df.schema.fields, T.StructField(best, T.IntegerType()), T.StructField(top, T.DoubleType()), T.StructField(both, T.DoubleType())])
    at, out = 0, df
    for prior, log_p in model.blocks:
        shared = df.sparkSession.sparkContext.broadcast((prior, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.slices(batches, text_col):
                total, letters = totals(texts, *shared.value)
                number, high = total.argmax(1) + at, total.max(1)
                every = high + np.log(np.exp(total - high[:, None]).sum(1))
                if at:
                    before, old, old_every = (np.asarray(batch.column(len(names) + k)) for k in range(3))
                    number = np.where(high > old, number, before)
                    high, every = np.maximum(high, old), np.logaddexp(every, old_every)
                number = np.where(letters > 0, number, -1).astype(np.int32)
                columns = [batch.column(k) for k in range(len(names))]
                yield pa.record_batch([*columns, pa.array(number), pa.array(high), pa.array(every)], [*names, best, top, both])

        if at:
            out = common.materialise(out, "languages")
        out = out.mapInArrow(run, schema)
        at += len(prior)
    known = F.col(best) >= 0
    language = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.greatest(F.col(best), F.lit(0)) + 1)
    return out.select(*[F.col(f"`{c}`") for c in names], F.when(known, language).otherwise(F.lit(UNKNOWN)).alias(lang_name), F.when(known, F.exp(F.col(top) - F.col(both))).otherwise(F.lit(0.0)).alias(score_name))

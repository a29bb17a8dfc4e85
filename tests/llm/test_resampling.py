"""Importance resampling against a version with strings, dictionaries and zlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskmart.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, orders=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        n, g = grams(text)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    drawn = [(x[1:], k + 1) for k, x in enumerate(fit[: len(fit) * percent // 100])]
    rest = [(x[1:], None) for x in fit[len(fit) * percent // 100 :]] + [(x[1:], None) for x in out if x[0] < least]
    return sorted(((*x, k) for x, k in drawn + rest), key=repr)


def rows_of(seed=3, n=120):
    rng = random.Random(seed)
    pick = ["a", "b9", "Ünï", "日本", "THE", "don't", "x" * 70, "y" * 300, "mid-dle", "\x00z"]
    text = lambda k: "".join(rng.choice(pick) + rng.choice([" ", "\n", ", ", "", "  "]) for _ in range(k))
    rows = [(i, rng.choice([None, "", " .,", text(3), text(40), text(60)])) for i in range(n)]
    return rows + [(None, text(50)), (None, text(50)), (5, rows[4][1]), (5, text(30)), (5, text(30)), (n, text(20_000)), (n + 1, "q" * 100_000)]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows_of()], "doc_id long, text string, score string, rank int, row int")


def test_crcs_are_put_together():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 64, 65, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(n)
        got = resampling.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("orders", [1, 2, 3])
@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_features_of_whole_and_cut_texts(orders, most):
    texts = [t for _, t in rows_of() if t][:40]
    for group in ([t] for t in texts) if most < 1 << 20 else [texts]:
        got = Counter()
        for _, crc, owner in resampling.features(pa.array(group, pa.large_string()), orders, most):
            got.update(zip(owner.tolist(), crc.tolist(), strict=True))
        assert got == Counter((k, zlib.crc32(g.encode())) for k, t in enumerate(group) for g in grams(t, orders)[1])


def test_resampling(spark, docs):
    target = ["a b9 the ünï a", None, "日本 a", ""]
    got = found(resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")))
    assert got == brute(rows_of(), target)
    assert sum(r[4] is not None for r in got) > 10
    empty = spark.createDataFrame([], "text string")
    assert found(resampling.resample(docs, empty)) == brute(rows_of(), [])
    assert resampling.resample(docs.where("false"), empty).count() == 0


def test_a_third_of_all_rows_alike(spark):
    rows = [(None, "a b " * 15)] * 40 + [(7, "c d " * 15)] * 40 + [(i, f"w{i} x " * 12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(resampling.resample(df, spark.createDataFrame([("c d e",)], "text string"))) == brute(rows, ["c d e"])

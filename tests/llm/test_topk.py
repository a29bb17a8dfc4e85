"""Exact top-k search against all scores in Python's whole numbers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from riskmart.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, every=20, k=20, scale=64.0):
    whole = [(n, i, [math.floor(x * scale) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i is None or i % every:
            continue
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j is None, j or 0) for m, j, c in whole if m != n and len(c) == len(q)]
        out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, query int").repartition(parts)


def vectors(seed, n, d=8, alike=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(d)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(alike)]


def is_query(every=20):
    return F.col("vec_id") % every == 0


@pytest.mark.parametrize("block_bytes", [300, topk.BLOCK_BYTES])
def test_odd_vectors_ties_and_repeated_ids(spark, block_bytes):
    rows = vectors(1, 150, alike=80)  # a third of all rows alike: ties beyond k
    rows += [(None, [0.1] * 8), (20, [0.3] * 8), (20, [0.3] * 8), (7, [0.3] * 8), (40, None), (60, [None] + [1.0] * 7), (80, [NAN] * 8), (100, [INF] * 8), (-20, [-0.5] * 8), (500, []), (520, []), (540, [1.0, 2.0]), (3, [1.0, 1.0])]
    assert found(topk.search(table(spark, rows), is_query(), block_bytes=block_bytes)) == brute(rows)


@pytest.mark.parametrize("bits", [1, 4])
def test_few_bins_take_more_rounds(spark, bits):
    rows = vectors(2, 90)
    assert found(topk.search(table(spark, rows), is_query(), k=7, bits=bits)) == brute(rows, k=7)


def test_products_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([1, -1]) * rng.randrange(2**rng.choice([3, 30, 50, 57]))) for _ in range(3)]) for i in range(60)]
    assert found(topk.search(table(spark, rows), is_query(5), k=6)) == brute(rows, 5, 6)


def test_small_and_empty_tables(spark):
    assert found(topk.search(table(spark, []), is_query())) == []
    for rows in ([(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [2.0])], [(20, [0.0]), (20, [0.0])]):
        assert found(topk.search(table(spark, rows, 1), is_query())) == brute(rows)


def test_blocks_of_queries_hold_all_of_them(spark):
    numbered = spark.range(1000).repartition(7).withColumn("number", F.monotonically_increasing_id()).persist()
    blocks = topk._blocks(numbered, 64)
    counts = [numbered.where(F.col("number").between(a, b)).count() for a, b in blocks]
    assert sum(counts) == 1000 and max(counts) <= 64 and len(blocks) == 16
    numbered.unpersist()

"""Exact top-k search by integer inner product: distributed histogram selection.

Each component x of a vector becomes floor(SCALE * x); a score is the inner product of two such vectors. All queries are scored against all rows, and scores are never kept. A
round counts, for each query, the scores in 2^BITS bins of one width, sums the counts over all tasks and finds the bin that holds the k-th largest; the next round counts within
that bin alone, until a bin is one score wide and the k-th value is known exactly. A last round keeps what is above that value, and of what equals it the rows of least id that a
query still lacks (a task never needs more of them than the whole), so ties of any number cost nothing; a window over what is kept gives the ranks.

Within a task a histogram is cut below the bin that holds the k-th largest score of the task's own: the k-th of all isn't smaller. So a task gives about k bins for a query.
Queries go through in blocks of BLOCK_BYTES, numbered by their place in a written table; a block (and a number for each of its queries after a round) is all that is ever on the
driver or broadcast, however many queries there are. The work is queries times rows, as asked for; nothing else grows faster than the input.

Vectors that are null, or hold null, NaN or infinite components, take no part. Vectors of other lengths aren't compared with each other; empty ones score 0. A row isn't a
candidate of its own; other rows with its id are, and repeated query rows each have a result. A row without id is no query; as a candidate it comes last among equal scores.
Products are exact: in doubles where these are exact, in whole numbers of any size elsewhere; components and scores beyond 64 bits count as the end of that range. A query with
fewer than k candidates gets them all; an empty table gives no rows. Columns besides the two named ones can have any name.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm import common

K, SCALE, BITS = 20, 64.0, 9
BLOCK_BYTES, QUERIES_AT_ONCE, ROWS_A_TASK = 4_000_000, 128, 200_000
_EXACT, _LAST = 2.0**53, 2**63 - 1
#: Kept rows of a task before they are cut to k a query.
_KEPT = 1 << 20


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact: doubles if all are below 2^53, else 64-bit integers."""
    x, y = q.astype(np.float64), c.astype(np.float64)
    s, size_q, size_c = x @ y.T, np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    if size_q.max() * size_c.max() < _EXACT * 0.999:  # then so are all partial sums
        return s
    i, k = np.nonzero(size_q[:, None] * size_c[None, :] >= _EXACT * 0.999)
    large = [min(_LAST, max(-_LAST - 1, sum(x * y for x, y in zip(q[a].tolist(), c[b].tolist(), strict=True)))) for a, b in zip(i, k, strict=True)]
    s[i, k] = 0
    s = s.astype(np.int64)
    s[i, k] = large
    return s


def _groups(batch: pa.RecordBatch):
    """(row, vec_id, has id, vectors) for each length of vectors."""
    row, ids = np.asarray(batch.column(0)), batch.column(1)
    has, vec_id = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
    vectors = batch.column(2)
    length = np.asarray(vectors.value_lengths())
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield row[at], vec_id[at], has[at], np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), int(d))


class Block:
    """Queries of one block, bits for each round: row (ascending), vec_id, vectors; low, above: where the k-th score is sought, and how many are known to be above; sought: whether there are k at all."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, vectors: list[np.ndarray], k: int, bound: float, bits: int = BITS):
        self.row, self.vec_id, self.k = row, vec_id, k
        self.length = np.array([len(v) for v in vectors])
        self.of = {int(d): np.flatnonzero(self.length == d) for d in np.unique(self.length)}
        self.vectors = {d: np.stack([vectors[i] for i in at]) for d, at in self.of.items()}
        most = max((float(np.linalg.norm(v.astype(np.float64), axis=1).max()) for v in self.vectors.values()), default=0.0) * bound
        most = min(_LAST, ceil(most * (1 + 1e-9)) + 1)
        self.bits, self.at_once = (2 * most + 1).bit_length(), bits
        self.low = np.full(len(row), -most - 1, np.int64)
        self.above, self.sought = np.zeros(len(row), np.int64), np.ones(len(row), bool)

    def chunks(self, batches):
        """(numbers of queries, their scores with a batch's candidates, pairs to leave out as one is the other, candidates' ids, whether they have one)."""
        for batch in batches:
            for row, vec_id, has, vectors in _groups(batch):
                queries = self.of.get(vectors.shape[1])
                if queries is None:
                    continue
                place = np.searchsorted(self.row, row)
                same = np.flatnonzero(self.row[np.minimum(place, len(self.row) - 1)] == row)
                own = np.full(len(self.row), -1)
                own[place[same]] = same
                for a in range(0, len(queries), QUERIES_AT_ONCE):
                    at = queries[a : a + QUERIES_AT_ONCE]
                    yield at, _scores(self.vectors[vectors.shape[1]][a : a + QUERIES_AT_ONCE], vectors), own[at], vec_id, has

    def histograms(self, batches):
        """One round in a task: (query, bin, n), from the top down to the bin of the task's own k-th score."""
        shift = np.uint64(max(0, self.bits - self.at_once))
        bins = 1 << min(self.at_once, self.bits)
        count, floor, lacks = np.zeros((len(self.row), bins), np.int32), self.low.copy(), self.k - self.above
        floor[~self.sought] = _LAST
        for at, s, own, _, _ in self.chunks(batches):
            i, c = np.nonzero(s >= floor[at, None])
            q = at[i]
            key = s[i, c].astype(np.int64).view(np.uint64) - self.low[q].view(np.uint64)
            ok = (c != own[i]) & self.sought[q] & (key >> shift < np.uint64(bins))
            i, place = i[ok], (key[ok] >> shift).astype(np.int64)
            count[at] += np.bincount(i * bins + place, minlength=len(at) * bins).reshape(len(at), bins).astype(np.int32)
            cut = (count[at, ::-1].cumsum(1) >= lacks[at, None]).sum(1) - 1
            floor[at] = np.where(self.sought[at], (self.low[at].view(np.uint64) + (np.maximum(cut, 0).astype(np.uint64) << shift)).view(np.int64), _LAST)
        cut = (count[:, ::-1].cumsum(1) >= lacks[:, None]).sum(1) - 1
        q, place = np.nonzero((count > 0) & (np.arange(bins)[None, :] >= cut[:, None]))
        yield pa.record_batch({"query": pa.array(q, pa.int32()), "bin": pa.array(place, pa.int32()), "n": pa.array(count[q, place], pa.int64())})

    def narrowed(self, found: list) -> None:
        """After a round: found has (query, bin, above) of the bins of the k-th scores; a query that isn't there has fewer than k candidates."""
        shift = max(0, self.bits - self.at_once)
        self.sought[:] = False
        for r in found:
            self.low[r.query] = int(self.low[r.query]) + (r.bin << shift)
            self.above[r.query] += r.above
            self.sought[r.query] = True
        self.bits = shift

    def kept(self, batches):
        """What a task has of the result: scores above the k-th, and equal ones of least ids."""
        parts, n = [], 0
        for at, s, own, vec_id, has in self.chunks(batches):
            i, c = np.nonzero((s >= self.low[at, None]) | ~self.sought[at, None])
            i, c = i[c != own[i]], c[c != own[i]]
            parts.append((at[i], s[i, c].astype(np.int64), vec_id[c], has[c]))
            n += len(i)
            if n > _KEPT:
                parts = [self._best(parts)]
                n = len(parts[0][0])
        if parts:
            q, s, vec_id, has = self._best(parts)
            yield pa.record_batch({"query": pa.array(q, pa.int32()), "query_id": pa.array(self.vec_id[q], pa.int64()), "vec_id": pa.array(vec_id, pa.int64(), mask=~has), "score": pa.array(s, pa.int64())})

    def _best(self, parts: list) -> tuple[np.ndarray, ...]:
        q, s, vec_id, has = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((vec_id, ~has, ~s, q))
        q = q[order]
        first = np.searchsorted(q, q)
        order = order[np.arange(len(q)) - first < self.k]
        q, s, vec_id, has = (np.concatenate(x)[order] for x in zip(*parts, strict=True))
        return q, s, vec_id, has


def _blocks(queries: DataFrame, size: int) -> list[tuple[int, int]]:
    """First and last number of each block of at most `size` queries; numbers count up within each partition."""
    out, n = [], size
    for r in sorted(queries.groupBy(F.shiftright("number", 33).alias("part")).agg(F.count("*").alias("n")).collect()):  # one row for each partition
        at, last = r.part << 33, (r.part << 33) + r.n
        while at < last:
            if n >= size:
                out.append([at, at])
                n = 0
            step = min(size - n, last - at)
            out[-1][1] = at + step - 1
            n, at = n + step, at + step
    return [tuple(x) for x in out]


def search(df: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of df for each of its rows that is_query (a condition on vec_id, the id as a long) holds for."""
    spark = df.sparkSession
    common.ship(spark)
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(scale))).alias("x"))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    parts = max(4 * spark.sparkContext.defaultParallelism, ceil(n / ROWS_A_TASK))
    rows = common.materialise(rows.repartition(parts).select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")
    bound = rows.agg(F.coalesce(F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))), F.lit(0.0))).first()[0]
    queries = common.materialise(rows.where(is_query & F.col("vec_id").isNotNull()).withColumn("number", F.monotonically_increasing_id()), "queries")
    path = common.new_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    blocks = _blocks(queries, max(1, block_bytes // (8 * max(1, longest))))
    for number, (first, last) in enumerate(blocks):
        own = sorted(queries.where(F.col("number").between(first, last)).select("row", "vec_id", "x").collect())  # block_bytes at most
        block = Block(np.array([r.row for r in own]), np.array([r.vec_id for r in own]), [np.array(r.x, np.int64) for r in own], k, bound, bits)
        _run(rows, block).write.mode("overwrite").parquet(f"{path}/block={number}")
    common.discard(queries)
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block") if blocks else spark.createDataFrame([], schema)


def _run(rows: DataFrame, block: Block) -> DataFrame:
    """All rounds of one block."""
    sc = rows.sparkSession.sparkContext
    downward = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
    while True:
        sent = sc.broadcast(block)
        counted = rows.mapInArrow(lambda batches, b=sent: b.value.histograms(batches), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        lacks = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(block.k - block.above)], "query int, lacks long")
        reached = counted.join(F.broadcast(lacks), "query").withColumn("sum", F.sum("n").over(downward)).where("sum >= lacks")
        found = reached.groupBy("query").agg(F.max("bin").alias("bin"), F.max_by(F.col("sum") - F.col("n"), "bin").alias("above")).collect()  # one row for each query of the block
        block.narrowed(found)
        sent.unpersist()
        if not block.bits:
            break
    sent = sc.broadcast(block)
    kept = rows.mapInArrow(lambda batches, b=sent: b.value.kept(batches), "query int, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= block.k).select("query_id", "rank", "vec_id", "score")

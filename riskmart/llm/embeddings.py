"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Vectors of equal label (and length) are compared by cosine. Unit vectors with cosine c lie sqrt(2 - 2 c) apart, and on a random
direction in d dimensions their projections differ by about a normal with that over sqrt(d) as deviation. A pair collides on a
projection if one lies in the window of WINDOW deviations around the other, the query. With PROJECTIONS of them, a pair at the
threshold misses few windows; `least_collisions` sets the count so that a pair there passes with RECALL at least. What passes is verified in
double precision.

Equal vectors are one weighted representative. Those are sorted by the first projection into tiles of about TILE rows; a tile meets only
the tiles that its widened windows reach, and those meetings are the tasks. A task keeps pairs to itself: it gives for each
vector its number of links and the least vector it is joined with, so a group of n near copies gives n rows, not n^2.

Labels of any type count by equality (text by its hash). Vectors without label or id, null, empty or zero ones and those with null or non-finite components link with nothing. Equal
vec_ids are one node of a component; each row has its own number of links. An empty table gives no rows. Columns besides the three named ones can have any name.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm import common
from riskmart.llm.components import components

THRESHOLD = 0.93
PROJECTIONS, WINDOW, RECALL = 40, 3.0, 0.9995
#: Projections counted for all pairs in reach; the rest are counted for pairs that can still pass.
DENSE = 16
#: Deviations that the first projection may differ by in reach (misses under one pair in 100,000 at the threshold).
REACH = 4.5
TILE, QUERIES, SEED = 4096, 256, 7


def directions(dims: int, n: int) -> np.ndarray:
    """n random directions, orthogonal in runs of dims."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(-(-n // dims))])[:n]


def least_collisions(n: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with this probability."""
    p, total = erf(window / sqrt(2)), 0.0
    for k in range(n, -1, -1):
        total += comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= recall:
            return k
    return 0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the links (a, b): each points at the least number of its component."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]


def linked(q: np.ndarray, c: np.ndarray, same: bool, threshold: float = THRESHOLD):
    """Blocks of verified links (numbers in q, numbers in c) between unit vectors; each pair once if q is c."""
    dims = q.shape[1]
    deviation = sqrt(max(0.0, 2 - 2 * threshold) / dims)
    u, least = directions(dims, PROJECTIONS), least_collisions()
    pq, pc_ = q @ u.T, c @ u.T
    oq, oc = np.argsort(pq[:, 0], kind="stable"), np.argsort(pc_[:, 0], kind="stable")
    pq, pc_, q, c = pq[oq], pc_[oc], q[oq], c[oc]
    # In sorted order a window is a range of ranks: a collision is a rank within it.
    kind = np.uint16 if len(c) < 1 << 16 else np.uint32
    rank, low, high = np.empty((PROJECTIONS, len(c)), kind), np.empty((PROJECTIONS, len(q)), kind), np.empty((PROJECTIONS, len(q)), kind)
    for j in range(PROJECTIONS):
        order = np.argsort(pc_[:, j], kind="stable")
        rank[j, order] = np.arange(len(c))
        ranked = pc_[order, j]
        low[j] = np.searchsorted(ranked, pq[:, j] - WINDOW * deviation, "left")
        high[j] = np.searchsorted(ranked, pq[:, j] + WINDOW * deviation, "right")
    wide = high - low
    for a in range(0, len(q), QUERIES):
        b = min(a + QUERIES, len(q))
        s = int(np.searchsorted(pc_[:, 0], pq[a, 0] - REACH * deviation, "left"))
        e = int(np.searchsorted(pc_[:, 0], pq[b - 1, 0] + REACH * deviation, "right"))
        if same:
            s = max(s, a)
        if s >= e:
            continue
        count = np.zeros((b - a, e - s), np.uint8)
        for j in range(DENSE):
            count += (rank[j, None, s:e] - low[j, a:b, None]) < wide[j, a:b, None]
        i, k = np.nonzero(count >= least - (PROJECTIONS - DENSE))
        if same:
            i, k = i[k + s > i + a], k[k + s > i + a]
        total = count[i, k]
        for j in range(DENSE, PROJECTIONS):
            total += (rank[j, k + s] - low[j, i + a]) < wide[j, i + a]
        i, k = i[total >= least], k[total >= least]
        if len(i):
            columns, at = np.unique(k, return_inverse=True)
            cosine = q[a:b] @ c[s + columns].T
            ok = cosine[i, at] >= threshold
            if ok.any():
                yield oq[i[ok] + a], oc[k[ok] + s]


def _meeting(table: pa.Table, threshold: float) -> pa.Table:
    """Links and least partners of the vectors of one meeting of tiles."""
    table = table.combine_chunks()
    label, dims, node, weight, side = (np.asarray(table.column(x)) for x in ("label", "dims", "node", "weight", "side"))
    nodes, links, roots = [], [], []
    both = side[0] == 2
    for key in np.unique(np.stack([label, dims], 1), axis=0):
        rows = np.flatnonzero((label == key[0]) & (dims == key[1]))
        qi, ci = (rows, rows) if both else (rows[side[rows] == 0], rows[side[rows] == 1])
        if not len(qi) or not len(ci):
            continue
        vectors = table.column("embedding").take(pa.array(rows)).combine_chunks()
        x = _unit(_matrix(vectors, int(key[1])))
        position = {r: k for k, r in enumerate(rows)} if not both else None
        q, c = (x, x) if both else (x[[position[r] for r in qi]], x[[position[r] for r in ci]])
        every = rows if both else np.concatenate([qi, ci])
        shift = 0 if both else len(qi)
        order = np.argsort(node[every], kind="stable")  # least node first
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        n, root, touched = np.zeros(len(every), np.int64), np.arange(len(every)), np.zeros(len(every), bool)
        for i, k in linked(q, c, both, threshold):
            k = k + shift
            n += np.bincount(i, weight[every[k]], len(every)).astype(np.int64) + np.bincount(k, weight[every[i]], len(every)).astype(np.int64)
            root = _merge(root, place[i], place[k])
            touched[i] = touched[k] = True
        found = np.flatnonzero(touched)
        nodes.append(every[found])
        links.append(n[found])
        roots.append(node[every[order[root[place[found]]]]])
    at = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
    return pa.table({"row": pa.array(np.asarray(table.column("row"))[at], pa.int64()), "node": pa.array(node[at], pa.int64()), "links": pa.array(np.concatenate(links) if links else at, pa.int64()), "root": pa.array(np.concatenate(roots) if roots else at, pa.int64())})


def _first_projection(batches):
    for batch in batches:
        if batch.num_rows:
            dims, vectors = np.asarray(batch.column(batch.schema.get_field_index("dims"))), batch.column(batch.schema.get_field_index("embedding"))
            p = np.empty(batch.num_rows)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                p[rows] = _unit(_matrix(vectors.take(pa.array(rows)), int(d))) @ directions(int(d), 1)[0]
            yield batch.append_column("p", pa.array(p))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    common.ship(df.sparkSession)
    # Labels that aren't whole numbers count by their text's hash.
    label = df[label_col].cast("long") if isinstance(df.schema[label_col].dataType, T.IntegralType) else F.xxhash64(df[label_col].cast("string"))
    label = F.when(df[label_col].isNotNull(), label)
    rows = df.select(df[id_col].cast("long").alias("vec_id"), label.alias("label"), df[vector_col].cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = rows.where("fit")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    reps = classes.select("label", F.size("embedding").alias("dims"), "node", "weight", "embedding").mapInArrow(_first_projection, "label long, dims int, node long, weight long, embedding array<double>, p double")
    total = good.count()
    n_tiles = max(1, round(total / tile))
    # Scaled copies share their projection: node and content tell them apart, so a tile can end among them.
    tiles = reps.repartitionByRange(n_tiles, "label", "dims", "p", "node", F.xxhash64("embedding")).withColumn("tile", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    tiles = common.materialise(tiles, "tiles")
    reach = F.lit(REACH) * F.sqrt(F.lit(max(0.0, 2 - 2 * threshold)) / F.col("dims"))
    spans = tiles.groupBy("label", "dims", "tile").agg(F.min("p").alias("low"), F.max("p").alias("high")).withColumn("reach", reach)
    x, y = spans.alias("x"), spans.alias("y")
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims")) & (F.col("x.tile") < F.col("y.tile")) & (F.col("x.high") + F.col("x.reach") >= F.col("y.low"))).select(F.col("x.tile").alias("a"), F.col("y.tile").alias("b")).distinct()
    # Rows of both tiles come to a meeting: side 0 and 1; a tile's meeting with itself is side 2.
    seats = meet.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("b").alias("tile"), F.lit(1).alias("side")))).alias("s")).select("a", "b", "s.tile", "s.side")
    alone = spans.select(F.col("tile").alias("a"), F.col("tile").alias("b"), "tile", F.lit(2).alias("side")).distinct()
    seated = tiles.join(seats.unionByName(alone), "tile").select("a", "b", "side", "row", "label", "dims", "node", "weight", "embedding")
    found = common.materialise(seated.groupBy("a", "b").applyInArrow(lambda t: _meeting(t, threshold), "row long, node long, links long, root long"), "links")
    sums = found.groupBy("row").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = tiles.select("label", "embedding", "node", "weight", "row").join(sums, "row", "left").join(of.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    least = least.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"), "weight")
    # A vector that very many rows have is dealt over tasks.
    done = common.join_to_keys(good.select("vec_id", "label", "embedding"), common.materialise(least, "classes"), ["label", "embedding"], total, "weight").select("vec_id", "n_links", "component_id")
    unfit = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(unfit).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

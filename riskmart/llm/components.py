"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is two aggregations and two joins; edges are written to the shared folder after every round, so a lost
executor costs a round at most, and nothing but two sums comes to the driver. A hub is no hot key: minima are pre-aggregated, and hubs with more than
1 / 10,000 of all edges get their minimum from a broadcast table (`common.join_to_keys`). Without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common


def _star(edges: DataFrame, total: int) -> DataFrame:
    """edges: (u, v) -> (u, v, m): m is the least of u and all its neighbours v."""
    least = common.materialise(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n_left")), "least")
    return common.join_to_keys(edges, least, "u", total)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long, any order, repeats allowed -> (node, root): every node of an edge and the least node that it reaches."""
    now = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total, state = now.count(), None
    while total:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "edges")
        small = _star(large, total)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = common.materialise(new, "edges")
        common.discard(now)
        common.discard(large)
        now = new
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = found[0]
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

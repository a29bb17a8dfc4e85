"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits over word shingles. For radius r every bit position gets a non-zero vector of r + 1 bits; table t
(1 <= t < 2^(r+1)) keeps the positions whose vector has an odd overlap with t. Any r positions span less than all r + 1
dimensions, so some t is orthogonal to all of them: a pair that differs there only collides in that table, always.

Equal fingerprints are one node. Buckets of two fingerprints give a pair; of up to PAIRS, pairs with a test; in larger ones
each fingerprint f names the points f and f with one bit flipped, and all that name one point are linked to the least of them:
they are within 2 of each other, and any two within 2 of each other name a common point. So no bucket is capped, and none
gives rows with the square of its size. That argument, and so this module, is for a radius of 2.

With a similarity given, documents link instead where their sets of shingles have that Jaccard similarity. At 0.8 fingerprints differ by about ten bits, far
beyond what covering tables can hold (2^(r+1) of them for radius r), so the seven tables name only some of the candidates there, MinHash bands the others, and the
sets decide: see `jaccard.py`.

Null text has no words: fingerprint zero, as texts without words. Documents with equal id are separate; a component's id is the
least doc_id in it (null only where all are). Texts are read whole, shingles in blocks. Only the two named columns are read, so others can have any name.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.llm import common
from riskmart.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 5, 42
PAIRS = 32
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    """Bit k is set if it is in over half of the XXH64 hashes of the text's shingles (A-Z lower-cased)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone, and space and the controls from tab to carriage return
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    count = np.zeros(BITS, np.int64)
    for a in range(0, n, _BLOCK):
        h = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins[a : a + _BLOCK], ends[a : a + _BLOCK], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch, texts in common.slices(batches):
            fp = np.array([fingerprint(x, shingle) for x in texts.cast(pa.large_binary()).to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fp.view(np.int64))})

    return common.as_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The positions that each table keeps, as signed longs."""
    vectors = [k % (2 ** (radius + 1) - 1) + 1 for k in range(BITS)]
    found = [sum(1 << k for k, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _points(fp: Column, mask: Column) -> Column:
    """The fingerprint and those with one of the bits outside of mask flipped, as an array."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(BITS)])
    return F.transform(F.filter(flips, lambda x: x.bitwiseAND(mask) == 0), lambda x: fp.bitwiseXOR(x))


def links(fps: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """fps: distinct fp -> (a, b): pairs within RADIUS, enough to join all fingerprints that any such pairs join."""
    tables = masks(RADIUS)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in tables])).alias("x")).select("fp", "x.mask", "x.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    twos = sizes.where("n = 2").where(_near(F.col("a"), F.col("b"))).select("a", "b")
    larger = common.materialise(sizes.where("n > 2").select("mask", "key", "n", F.col("n").alias("n_left")), "larger")
    more = common.materialise(common.join_to_keys(keyed, larger, ["mask", "key"], fps.count() * len(tables)), "buckets")
    small = more.where(F.col("n") <= pairs).select("mask", "key", "fp")
    other = small.select("mask", "key", F.col("fp").alias("other"))
    paired = small.join(other, ["mask", "key"]).where(F.col("fp") < F.col("other")).where(_near(F.col("fp"), F.col("other"))).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    points = more.where(F.col("n") > pairs).select("mask", "fp", F.explode(_points(F.col("fp"), F.col("mask"))).alias("point"))
    # At most 65 fingerprints name a point.
    starred = points.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("mask", "point")).alias("b")).where("a <> b")
    return twos.unionByName(paired).unionByName(starred).distinct()


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp, component_id of every document; with a similarity (a fraction: over, under) row and component, of a unique integer id_col."""
    if similarity:
        from riskmart.llm import jaccard

        return jaccard.near_duplicates(df, shingle, id_col, text_col, similarity=similarity)
    docs = common.materialise(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    first = common.materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_left")), "distinct-fingerprints")
    of = common.materialise(components(links(first.select("fp"))).join(first.select(F.col("fp").alias("node"), "first"), "node"), "linked")
    least = common.materialise(of.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_left")), "least")
    linked = common.join_to_keys(of, least, "root", of.count()).select(F.col("node").alias("fp"), "component_id")
    grouped = common.materialise(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n_left"), "grouped")
    return common.join_to_keys(docs, grouped, "fp", docs.count()).select("doc_id", "fp", "component_id")

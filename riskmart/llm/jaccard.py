"""Near-duplicates by the Jaccard similarity of word shingles: SimHash tables and MinHash bands name candidates, the sets themselves decide.

A text's set is the 64-bit hashes (not verified) of its SHINGLE-word windows, A-Z lower-cased; a shorter text is one shingle. Two texts are near copies
if their sets have the similarity. Candidates share one of the covering tables of a SimHash fingerprint over the set (all pairs within two bits do), or one of BANDS
bands of ROWS minima: a pair at 0.8 with a probability of 1 - (1 - 0.8^5)^24 = 0.9999, pairs above with more. All candidates are checked on their sets.

Equal sets are one node. Pairs are never made of large buckets (over PAIRS nodes): sets meet in groups in Python, which give no more links than join their
components. First each node of large buckets meets up to LEADERS nodes that lead one of them: a bucket's leader is the node with most company in all its
large buckets, so that of a family the one in the middle leads. Then, for each bucket, the nodes outside of its most frequent component so far meet
all of that component, and each other. So each two nodes of a bucket that are in different components are checked, whatever its size; a family costs rows in proportion to its size.
Buckets of many large families that are apart cost their product. Groups are blocks of up to about HASHES hashes, and blocks of one component or bucket meet pairwise.
Texts without words, null or empty, are one node. Ids must be unique. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common, simhash, words
from riskmart.llm.components import components

SHINGLE, BANDS, ROWS, SEED = 5, 24, 5, 42
#: A fraction, so that the check is exact.
SIMILARITY = (4, 5)
#: Shingles whose bits are counted at once.
_BITS_AT_ONCE = 1 << 16
PAIRS, LEADERS = 12, 2
#: Hashes of sets in a block.
HASHES = 1_500_000


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and the n + 1 offsets of the texts in them."""
    data, offsets = common.text_bytes(texts)
    data = words.ASCII_LOWER[data]
    found = words.find(data, offsets)
    h = words.hashes(data, found.start, found.end)
    n = np.diff(found.first)
    text = np.repeat(np.arange(len(n)), n)
    at, hashed = words.windows(h, found.first, size)
    owners, values = [text[at]], [hashed]
    for k in range(1, size):
        if (n == k).any():
            at, hashed = words.windows(h, found.first, k)
            whole = n[text[at]] == k
            owners.append(text[at[whole]])
            values.append(hashed[whole])
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def fingerprints(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A SimHash of each set: bit k is set if it is in over half of the set's hashes."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    count = np.zeros((len(n), simhash.BITS), np.int64)
    for a in range(0, len(value), _BITS_AT_ONCE):
        bits = np.unpackbits(value[a : a + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + _BITS_AT_ONCE]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        count[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return np.packbits(count * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def signatures(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """row, node (a hash of the text's set), n (its size), keys: of its bands, then of the covering tables, no two of which have keys in common."""
    factors, adds = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
    factors |= np.uint64(1)
    masks = np.array(simhash.masks(simhash.RADIUS), np.int64).view(np.uint64)
    n_keys = BANDS + len(masks)
    salts = np.arange(1, n_keys + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # so that a key names its band too

    def run(batches):
        for batch, texts in common.slices(batches):
            value, offsets = sets(texts, size)
            n = np.diff(offsets)
            has = np.flatnonzero(n)
            node, keys = np.zeros(len(n), np.uint64), np.zeros((len(n), n_keys), np.uint64)
            if len(has):
                starts = offsets[:-1][has]
                node[has] = words.mix(np.add.reduceat(words.mix(value), starts) + n[has].astype(np.uint64))
                for k in range(BANDS * ROWS):
                    least = np.minimum.reduceat(value * factors[k] + adds[k], starts)
                    keys[has, k // ROWS] = words.mix(keys[has, k // ROWS] * np.uint64(31) + least)
                keys[:, BANDS:] = fingerprints(value, offsets)[:, None] & masks
                keys = words.mix(keys + salts)
            ends = pa.array(np.arange(len(n) + 1) * n_keys, pa.int32())
            yield pa.record_batch({"row": batch.column(0), "node": pa.array(node.view(np.int64)), "n": pa.array(n.astype(np.int64)), "keys": pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))})

    return common.as_text(df, id_col, text_col).mapInArrow(run, "row long, node long, n long, keys array<long>")


def _sets_of(df: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """row, hashes."""

    def run(batches):
        for batch, texts in common.slices(batches):
            value, offsets = sets(texts, size)
            yield pa.record_batch({"row": batch.column(0), "hashes": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))})

    return common.as_text(df, id_col, text_col).mapInArrow(run, "row long, hashes array<long>")


def _similar(pairs: DataFrame, hashes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""
    up, down = similarity
    a = hashes.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    b = hashes.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    pairs = common.materialise(pairs, "pairs")
    total = pairs.count()

    def counted(side: DataFrame, name: str) -> DataFrame:  # a text may be in many pairs
        return side.join(pairs.groupBy(name).agg(F.count("*").alias("n_left")), name)

    both = F.size("of_a") + F.size("of_b")
    # i / (both - i) >= up / down
    sizes = F.least(F.size("of_a"), F.size("of_b")) * down >= F.greatest(F.size("of_a"), F.size("of_b")) * up
    found = common.join_to_keys(common.join_to_keys(pairs, counted(a, "a"), "a", total), counted(b, "b"), "b", total)
    return found.where(sizes).where(F.size(F.array_intersect("of_a", "of_b")) * (up + down) >= both * up).select("a", "b")


def _meet(table: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    """Links (a, b) between sets of a group: between queries and all, enough to join what is similar and not joined yet (equal root)."""
    up, down = similarity
    table = table.combine_chunks()
    node, query = table.column("node").to_numpy(), table.column("query").to_numpy()
    _, label = np.unique(table.column("root").to_numpy(), return_inverse=True)
    sets_ = table.column("hashes").chunk(0)
    offsets = np.asarray(sets_.offsets).astype(np.int64)
    distinct, ids = np.unique(np.asarray(sets_.flatten()), return_inverse=True)
    begin, n = offsets[:-1] - offsets[0], np.diff(offsets)
    mark = np.zeros(len(distinct), bool)
    links: list[tuple[int, int]] = []
    for q in np.flatnonzero(query):
        own = ids[begin[q] : begin[q] + n[q]]
        mark[own] = True
        common_ = np.add.reduceat(mark[ids], begin, dtype=np.int64)
        mark[own] = False
        ok = np.flatnonzero((common_ * (up + down) >= (n[q] + n) * up) & (label != label[q]))
        for other, k in zip(*np.unique(label[ok], return_index=True), strict=True):
            links.append((int(node[q]), int(node[ok[k]])))
            label[label == other] = label[q]
        if len(links) and (label == label[0]).all():
            break
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _linked(seats: DataFrame, hashes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """seats: group, node, root, query -> (a, b)."""
    return seats.join(hashes, "node").groupBy("group").applyInArrow(lambda t: _meet(t, similarity), "a long, b long")


def _blocks(n: str) -> Column:
    return F.greatest(F.ceil(F.sum(n) / HASHES), F.lit(1)).cast("int")


def _crowd(members: DataFrame, queries: DataFrame, what: str) -> DataFrame:
    """Seats of the groups named by the column `what`: blocks of its members (node, n, root) with blocks of its queries (node, n, root)."""
    m = members.groupBy(what).agg(_blocks("n").alias("m"), F.count("*").alias("n_m"))
    q = queries.groupBy(what).agg(_blocks("n").alias("q"), F.count("*").alias("n_q"))
    shape = common.materialise(m.join(q, what), "shape")  # groups without queries have nothing to do
    seats = []
    for rows, is_query, own, other, n in ((members, False, "m", "q", "n_m"), (queries, True, "q", "m", "n_q")):
        of = shape.select(what, own, other, F.col(n).alias("n_left"))
        x = common.join_to_keys(rows, of, what, rows.count()).withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("other", "own") if is_query else ("own", "other")
        seats.append(x.select(F.xxhash64(what, *pair).alias("group"), "node", "root", F.lit(is_query).alias("query")))
    return seats[0].unionByName(seats[1])


def _to_leaders(large: DataFrame) -> DataFrame:
    """node, n, leader, leader_n: each node of the large buckets with up to LEADERS of their leaders, those with most company."""
    company = large.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = common.materialise(large.join(company, "node"), "company")
    leaders = common.materialise(ranked.groupBy("key").agg(F.max(F.struct("company", "node", "n")).alias("leader"), F.count("*").alias("n_left")), "leaders")
    led = common.join_to_keys(ranked.select("key", "node", "n"), leaders, "key", ranked.count()).where("node <> leader.node")
    best = led.groupBy("node", "n").agg(F.slice(F.sort_array(F.collect_set("leader"), False), 1, LEADERS).alias("best"))
    return common.materialise(best.select("node", "n", F.explode("best").alias("l")).select("node", "n", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n")), "led")


def near_duplicates(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """row (of id_col, which must be unique), component (the same for texts that near copies join)."""
    rows = common.materialise(signatures(df, size, id_col, text_col), "signatures")
    nodes = common.materialise(rows.groupBy("node").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("n_left")), "nodes")
    keyed = nodes.where("n > 0").select("node", "row", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("of")).where("size > 1")
    # Keys with the same nodes say nothing new.
    buckets = common.materialise(sizes.groupBy("size", "of").agg(F.min("key").alias("key")).select("key", "size", F.col("size").alias("n_left")), "buckets")
    n_keys = nodes.count() * (BANDS + 2 ** (simhash.RADIUS + 1) - 1)
    members = common.materialise(common.join_to_keys(keyed, buckets, "key", n_keys), "candidates")
    found = common.materialise(members.select(F.col("row").alias("_member"), F.col("node").alias("_node")).distinct(), "members")
    hashes = _sets_of(df.join(found, df[id_col] == F.col("_member"), "left_semi"), size, id_col, text_col)
    hashes = common.materialise(hashes.join(found, F.col("row") == F.col("_member")).select(F.col("_node").alias("node"), "hashes"), "sets")
    small, large = members.where(F.col("size") <= pairs), members.where(F.col("size") > pairs)
    other = small.select("key", F.col("node").alias("other"))
    paired = small.select("key", "node").join(other, "key").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    if large.isEmpty():
        links = common.materialise(_similar(paired, hashes, similarity), "links")
    else:
        led = _to_leaders(large)
        queries = led.select("leader", F.col("leader").alias("node"), F.col("leader_n").alias("n")).distinct()
        seats = _crowd(led.select("leader", "node", "n", F.col("node").alias("root")), queries.withColumn("root", F.col("node")), "leader")
        links = common.materialise(_linked(seats, hashes, similarity), "links")
        root = common.materialise(components(links), "joined").withColumnRenamed("root", "_root")
        # Small buckets: pairs that are not joined yet.
        for side in ("a", "b"):
            paired = paired.join(root.select(F.col("node").alias(side), F.col("_root").alias(f"root_{side}")), side, "left")
        paired = paired.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        # Large ones: nodes apart from the most frequent component of a bucket.
        of = common.materialise(large.join(root, "node", "left").select("key", "node", "n", F.coalesce("_root", "node").alias("root")), "large-buckets")
        many = of.groupBy("key", "root").agg(F.count("*").alias("count"))
        most = many.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("n_left"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        apart = common.materialise(common.join_to_keys(of, common.materialise(most, "most"), "key", of.count()).where("root <> most"), "apart")
        to = apart.select(F.col("most").alias("component"), "node", "n", "root").distinct()
        crowd = of.select(F.col("root").alias("component"), "node", "n", "root").distinct().join(to.select("component").distinct(), "component", "left_semi")
        among = apart.select(F.col("key").alias("bucket"), "node", "n", "root")
        seats = _crowd(crowd, common.materialise(to, "queries"), "component").unionByName(_crowd(among, among, "bucket"))
        more = _linked(seats.dropDuplicates(["group", "node", "query"]), hashes, similarity)
        links = common.materialise(links.unionByName(more).unionByName(_similar(paired, hashes, similarity)), "links")
    joined = common.materialise(components(links), "joined")
    of = nodes.select("node", "n_left").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "n_left")
    out = common.materialise(common.join_to_keys(rows.select("row", "node"), common.materialise(of, "of"), "node", rows.count()).select("row", "component"), "components")
    for x in (rows, nodes, buckets, members, found, hashes, links, joined):
        common.discard(x)
    return out

"""Target-distribution importance resampling over hashed n-grams, with CRC combination algebra.

Features of a text are its runs of 1 to ORDERS words (runs of the bytes of ASCII letters, digits and all beyond ASCII; A-Z lower-cased), joined by one space; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. CRC-32 is linear over GF(2): the CRC of A followed by B is that of A, multiplied by the matrix that shifts by the length
of B, xor that of B. So each word's CRC is computed once, and those of n-grams are put together from them; no n-gram is ever a string. The matrices are kept as tables by byte.

A bucket's gain compares its share in the target with that in the documents (both smoothed by one); a document's weight is the floored mean of its features' gains. With the
Gumbel noise that a hash of its id gives, the highest scores among the documents with LEAST_WORDS words are a sample without replacement in proportion to exp(weight / 1000).
Counts are of all rows; BUCKETS of them, whatever the input, come to the driver. Ranks come from a global sort over range partitions: no task sees all rows.

Null texts have no words: weight 0. A null id is hashed as empty text, and comes last among ties. Rows with equal ids are scored and drawn each on their own (they share their
noise). Ties in all are settled by position. Texts are read whole: a long one in pieces of about PIECE bytes, cut between words. Empty documents or an empty target are counted as
they are; an empty table gives no rows. Columns besides the two named ones can have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common, words

BUCKETS, ORDERS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
PIECE = 1 << 20
#: Words up to this many bytes go through the byte table together, longer ones by themselves.
_SHORT = 64
_POLYNOMIAL = 0xEDB88320
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return c


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix times each of the 32-bit vectors x; a table has the images of each byte at each of its four places."""
    out = table[0, x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k, (x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Shifts by 0 to _SHORT bytes, and by 2^j bytes."""
    at = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    one = _BYTES[at & np.uint32(255)] ^ (at >> np.uint32(8))  # the register after one zero byte
    near, powers = [at], [one]
    for _ in range(_SHORT):
        near.append(_apply(one, near[-1]))
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(near), np.stack(powers)


_BYTES = _byte_table()
_NEAR, _POWERS = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved by so many bytes: xor that of what follows, they are those of the whole."""
    near = np.minimum(length, _SHORT)
    near[length > _SHORT] = 0
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= _NEAR[near, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    far = np.flatnonzero(length > _SHORT)
    if len(far):
        x, n = out[far], length[far]
        for j in range(int(n.max()).bit_length()):
            has = (n >> j) & 1 == 1
            x[has] = _apply(_POWERS[j], x[has])
        out[far] = x
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte range."""
    length = end - start
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(length > _SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    order = np.flatnonzero(length <= _SHORT)
    order = order[np.argsort(-length[order], kind="stable")]  # longest first: those with a byte left are a prefix
    at, state = start[order], np.full(len(order), _ONES)
    left = np.searchsorted(-length[order], -np.arange(1, _SHORT + 1), "right")
    for k in range(_SHORT):
        m = left[k]
        if not m:
            break
        state[:m] = _BYTES[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[order] = state ^ _ONES
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bytes, offsets of the texts in them, whether they go on with the text before): all texts at once, or a piece of a long one; pieces end between words."""
    if len(data) <= most or len(offsets) > 2:
        yield data, offsets, False
        return
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        while b < len(data):
            gap = np.flatnonzero(_SEPARATOR[data[b : b + most]])
            b += int(gap[0]) if len(gap) else min(most, len(data) - b)
            if len(gap):
                break
        yield data[a:b], np.array([0, b - a]), a > 0
        a = b


def features(texts: pa.Array, orders: int = ORDERS, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, CRC-32, number of the text) of all runs of 1 to orders words."""
    data, offsets = common.text_bytes(texts)
    kept = (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64))
    for piece, ends, goes_on in _pieces(words.ASCII_LOWER[data], offsets, most):
        w = words.find(piece, ends, _SEPARATOR)
        length = w.end - w.start
        crc = word_crcs(piece, w.start, w.end)
        spaced = shift(np.full(len(crc), _SPACE), length) ^ crc
        new = (crc, length, spaced, np.repeat(np.arange(len(ends) - 1), np.diff(w.first)))
        old = len(kept[0]) if goes_on else 0
        crc, length, spaced, owner = (np.concatenate([x[len(x) - old :], y]) for x, y in zip(kept, new, strict=True))
        yield 1, crc[old:], owner[old:]
        h = crc
        for n in range(2, orders + 1):
            m = len(crc) - n + 1
            if m <= 0:
                break
            last = np.arange(n - 1, n - 1 + m)
            h = shift(h[:m], length[last] + 1) ^ spaced[last]
            whole = (owner[:m] == owner[last]) & (last >= old)
            yield n, h[whole], owner[:m][whole]
        kept = tuple(x[max(0, len(x) - orders + 1) :] for x in (crc, length, spaced, owner))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """Features of all rows in each bucket. A task gives a row for each bucket it has; their sums, as many as buckets, come to the driver."""
    common.ship(df.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in common.slices(batches):
            for _, crc, _ in features(texts, orders):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in df.select(df[text_col].cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored 1000-fold logarithm of the ratio of its smoothed shares."""
    n, s_all, t_all = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    sent = df.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def weigh(batches):
        own = sent.value
        for batch, texts in common.slices(batches):
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for order, crc, owner in features(texts, orders):
                count = np.bincount(owner, minlength=batch.num_rows)
                n += count
                if order == 1:
                    n_words += count
                total += np.bincount(owner, own[crc % np.uint32(len(own))], batch.num_rows).astype(np.int64)  # sums of a slice are exact in doubles
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)})

    return common.as_text(df, id_col, text_col).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(df: DataFrame, most: int, *order) -> DataFrame:
    """df with the ranks from 1 of its first `most` rows in an order that tells all rows apart, null for the rest. Rows are sorted over range partitions and written; a row's rank is its place in its partition and the sum of those before."""
    place = F.monotonically_increasing_id()  # the partition's number, and the place in it
    sorted_ = common.materialise(df.orderBy(*order).withColumn("_place", place), "ranked")
    part = F.shiftright("_place", 33)
    sizes = sorted(sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r.part, before))
        before += r.n
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    numbered = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = F.col("_before") + F.col("_place") - F.shiftleft("_part", 33) + 1
    return numbered.withColumn("rank", F.when(rank <= most, rank)).drop("_part", "_before", "_place")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn."""
    gain = gains(bucket_counts(documents, text_col, buckets, orders), bucket_counts(target, target_col, buckets, orders))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(documents, gain, id_col, text_col, orders).withColumns({"score": F.col("weight") + gumbel, "row": F.monotonically_increasing_id()})
    scored = common.materialise(scored, "weights")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    drawn = ranked(scored.where(fit), n * percent // 100, F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(*out))
